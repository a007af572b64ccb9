"""The opN_ queries and their SQL."""
from __future__ import annotations

from . import exact_dedup, license_scan, mixing, packing, pii, quotes, simhash, suffix_dedup, syncmers, toxicity

QUERIES = {"op1_pii": pii.op1, "op2_exact_dedup": exact_dedup.op2, "op3_simhash": simhash.op3, "op4_toxicity": toxicity.op4,
           "op5_packing": packing.op5, "op6_license_scan": license_scan.op6, "op7_mixing": mixing.op7,
           "op8_suffix_dedup": suffix_dedup.op8, "op9_quotes": quotes.op9, "op10_syncmers": syncmers.op10}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.SQL}
