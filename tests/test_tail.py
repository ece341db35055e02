"""A stream over growing files: growth, restart, truncation; only new bytes are read."""

import pytest

from meshwright.streaming import logs
from meshwright.streaming import tail as T


def drain(spark, folder, out, **more):
    return sorted((r.path.rsplit("/")[-1], r.at, r.line) for r in logs.drained(T.tail(spark, f"file://{folder}", **more), out=f"file://{out}").collect())


def test_growth_restart_and_truncation(spark, tmp_path):
    logs_, out = tmp_path / "logs", tmp_path / "out"
    logs_.mkdir()
    a, b = logs_ / "a.log", logs_ / "b.log"
    a.write_text("one\ntwo\nthr")
    b.write_text("é\n\n")
    first = drain(spark, logs_, out)
    assert first == [("a.log", 0, "one"), ("a.log", 4, "two"), ("b.log", 0, "é"), ("b.log", 3, "")]
    # every call is a query started anew from its checkpoint
    assert drain(spark, logs_, out) == first
    a.write_text("one\ntwo\nthree\nfour\n")
    second = drain(spark, logs_, out)
    assert sorted(set(second) - set(first)) == [("a.log", 8, "three"), ("a.log", 14, "four")]
    # a shorter file is another file
    a.write_text("new\n")
    (logs_ / "c.log").write_text("c\n")
    (logs_ / "c.txt").write_text("not a log\n")
    third = drain(spark, logs_, out)
    assert sorted(set(third) - set(second)) == [("a.log", 0, "new"), ("c.log", 0, "c")] and len(third) == len(second) + 2


@pytest.mark.parametrize("step", [1, 3, 7, 1000])
def test_ranges_give_each_line_once_and_read_only_news(tmp_path, step):
    path = tmp_path / "x.log"
    lines = ["first", "", "äö", "x" * 40, "", "last"]
    data = ("\n".join(lines) + "\n").encode()
    path.write_bytes(b"old line\n" + data + b"unfinished")
    reader = T.TailReader({"path": f"file://{tmp_path}", "rangebytes": str(step)})
    end = reader.latestOffset()
    (key,) = end
    parts = reader.partitions({key: 9}, end)
    assert sum(p.stop - p.start for p in parts) == len(data) and parts[0].start == 9
    got = [row for p in parts for row in reader.read(p)]
    assert [line for _, _, line in got] == lines and [at for _, at, _ in got] == [9 + len("\n".join(lines[:k] + [""]).encode()) for k in range(len(lines))]


def test_begins_where_it_is_told_and_numbers_lines(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\nthree\n")
    (folder / "b.log").write_text("x\n")
    (folder / "c.log").write_text("y\nz\n")
    begun = T.tail(spark, f"file://{folder}", range_bytes=3, offsets={f"file:{folder}/a.log": 4, f"{folder}/b.log": 1 << 40, f"{folder}/c.log": 4})
    lines = T.numbered_lines(logs.drained(begun, out=f"file://{tmp_path}/out"))
    assert sorted((r.path.rsplit("/")[-1], r.n, r.line) for r in lines.collect()) == [("a.log", 1, "two"), ("a.log", 2, "three"), ("b.log", 1, "x")]
    (folder / "c.log").write_text("y\nz\nw\n")
    # the checkpoint, not the stated places, says where to go on
    more = T.tail(spark, f"file://{folder}", range_bytes=3, offsets={f"{folder}/a.log": 4})
    assert sorted(r.line for r in logs.drained(more, out=f"file://{tmp_path}/out").collect()) == ["three", "two", "w", "x"]


def test_no_files_and_no_whole_line(spark, tmp_path):
    reader = T.TailReader({"path": f"file://{tmp_path}"})
    assert reader.latestOffset() == {} and list(reader.read(reader.partitions({}, {})[0])) == []
    (tmp_path / "y.log").write_text("no end")
    assert list(reader.latestOffset().values()) == [0]


def test_blocks_shorter_than_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 4)
    (tmp_path / "z.log").write_text("a long line\nshort\n\nnext")
    reader = T.TailReader({"path": f"file://{tmp_path}", "rangebytes": "5"})
    end = reader.latestOffset()
    assert list(end.values()) == [19]
    assert [r[2] for p in reader.partitions({}, end) for r in reader.read(p)] == ["a long line", "short", ""]


def test_a_stream_without_rows_gives_none(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert drain(spark, tmp_path / "none", tmp_path / "out") == []
