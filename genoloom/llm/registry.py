"""Queries of this subpackage and their SQL, as the entry module registers them."""

from __future__ import annotations

from .ann import op9_nearest_neighbours
from .decontaminate import op5_decontaminate
from .decontaminate import oracle as op5_sql
from .packing import op8_best_fit_packing
from .secrets import op4_secret_scan
from .simhash import op2_simhash_dedup
from .substring_dedup import op10_substring_dedup
from .substring_dedup import oracle as op10_sql
from .suffix_dedup import op6_suffix_dedup
from .suffix_dedup import oracle as op6_sql
from .token_files import op7_token_files
from .toxicity import op3_toxicity
from .url_filter import op1_url_filter
from .url_filter import oracle as op1_sql

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash_dedup, op3_toxicity, op4_secret_scan, op5_decontaminate, op6_suffix_dedup, op7_token_files, op8_best_fit_packing, op9_nearest_neighbours, op10_substring_dedup)}
ORACLE_SQL = {"op1_url_filter": op1_sql(), "op5_decontaminate": op5_sql(), "op6_suffix_dedup": op6_sql(), "op10_substring_dedup": op10_sql()}
