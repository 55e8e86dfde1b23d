"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from plumbframe.llm import bpe, decontam, jaccard, licenses, mixing, quality, secrets, topk, toxicity, warc
from plumbframe.llm.common import configured

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontam": decontam.op3_decontam,
    "op4_warc": warc.op4_warc,
    "op5_bpe_counts": bpe.op5_bpe_counts,
    "op6_topk": topk.op6_topk,
    "op7_secrets": secrets.op7_secrets,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_quality": quality.op9_quality,
    "op10_licenses": licenses.op10_licenses,
}
QUERIES = {name: configured(query) for name, query in QUERIES.items()}

ORACLES = {
    "op1_mix": mixing.ORACLE,
    "op3_decontam": decontam.ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_topk": topk.ORACLE,
    "op8_jaccard": jaccard.ORACLE,
    "op10_licenses": licenses.oracle(),
}
