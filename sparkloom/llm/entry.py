"""Queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from . import chunks, decontam, jaccard, licenses, lines, tools, warc
from .bpe import op6_bpe
from .quality import op10_quality
from .secrets import op2_secrets

QUERIES = {
    "op1_line_rules": lines.op1_line_rules,
    "op2_secrets": op2_secrets,
    "op3_licenses": licenses.op3_licenses,
    "op4_tool_calls": tools.op4_tool_calls,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_bpe": op6_bpe,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_chunks": chunks.op8_chunks,
    "op9_warc": warc.op9_warc,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    "op3_licenses": licenses.SQL,
    "op4_tool_calls": tools.SQL,
    "op1_line_rules": lines.SQL,
    "op5_jaccard": jaccard.SQL,
    "op7_decontamination": decontam.SQL,
    "op9_warc": warc.SQL,
}
