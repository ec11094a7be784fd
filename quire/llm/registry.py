"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quire.llm import align, decontaminate, langid, mixing, negatives, ngram_join, pieces, pii, secrets, spotsigs, token_files, topk, warc


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run, "op1_tokens": token_files.op1_tokens, "op2_topk": topk.op2_topk, "op3_pii": pii.op3_pii, "op4_pieces": pieces.op4_pieces, "op5_secrets": secrets.op5_secrets, "op6_warc": warc.op6_warc, "op7_langid": langid.op7_langid, "op8_spotsigs": spotsigs.op8_spotsigs, "op9_mixing": mixing.op9_mixing, "op10_ngram_join": ngram_join.op10_ngram_join, "op11_decontaminate": decontaminate.op11_decontaminate, "op12_negatives": negatives.op12_negatives, "op13_align": align.op13_align}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.OP2_SQL, "op6_warc": warc.OP6_SQL, "op9_mixing": mixing.OP9_SQL, "op10_ngram_join": ngram_join.OP10_SQL, "op11_decontaminate": decontaminate.OP11_SQL, "op12_negatives": negatives.OP12_SQL}
