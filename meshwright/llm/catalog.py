"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .flac import op10_flac_media
from .licenses import op7_licence_scan
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import OP8_SQL, op8_poisson_mixing
from .negatives import OP11_SQL, op11_strassen_negatives
from .packing import op3_pattern_packing
from .retrieval import op12_retrieval_packing
from .simhash import op2_simhash_components
from .suffix import op4_run_length_dedup
from .tokens import op1_token_counts
from .toxicity import op5_toxicity_machine
from .warc import op9_arc_to_warc
from .weighted import op6_weighted_fingerprints

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash_components": op2_simhash_components,
    "op3_pattern_packing": op3_pattern_packing,
    "op4_run_length_dedup": op4_run_length_dedup,
    "op5_toxicity_machine": op5_toxicity_machine,
    "op6_weighted_fingerprints": op6_weighted_fingerprints,
    "op7_licence_scan": op7_licence_scan,
    "op8_poisson_mixing": op8_poisson_mixing,
    "op9_arc_to_warc": op9_arc_to_warc,
    "op10_flac_media": op10_flac_media,
    "op11_strassen_negatives": op11_strassen_negatives,
    "op12_retrieval_packing": op12_retrieval_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL = {
    "op8_poisson_mixing": OP8_SQL,
    "op11_strassen_negatives": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
