"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, line_dedup, neural_lm, ngram_join, suffix_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_lm": neural_lm.op5_lm,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_bpe": bpe.op7_bpe,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}
SQL = {
    "op1_warc": warc.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
