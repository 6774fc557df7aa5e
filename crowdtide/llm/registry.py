"""The operators' queries over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from crowdtide.llm import (
    chat,
    collocations,
    kneser_ney,
    line_dedup,
    mtree,
    multi_index,
    packing,
    periodic_runs,
    pii,
    quality,
    sentence_pieces,
    simhash,
    toxicity,
)

QUERIES = {
    "op1_multi_index": multi_index.op1_multi_index,
    "op2_pii": pii.op2_pii,
    "op3_sentence_pieces": sentence_pieces.op3_sentence_pieces,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op6_kneser_ney": kneser_ney.op6_kneser_ney,
    "op7_chat": chat.op7_chat,
    "op8_mtree": mtree.op8_mtree,
    "op9_quality": quality.op9_quality,
    "op10_simhash": simhash.op10_simhash,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op7_chat": chat.OP7_SQL,
    "op8_mtree": mtree.OP8_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
