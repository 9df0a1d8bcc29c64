"""The registered queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline

from . import align, bpe, chat, decontaminate, embeddings, language, linededup, repair, reshard, simhash, substrings, tokenfiles, toxicity

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_chat": chat.op2_chat,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_reshard": reshard.op5_reshard,
    "op6_token_files": tokenfiles.op6_token_files,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_language": language.op8_language,
    "op9_bpe": bpe.op9_bpe,
    "op10_embeddings": embeddings.op10_embeddings,
    "op11_align": align.op11_align,
    "op12_substrings": substrings.op12_substrings,
    "op13_repair": repair.op13_repair,
    "pipeline": corpus_pipeline.run,
}

SQL = {"op1_line_dedup": linededup.OP1_SQL, "op2_chat": chat.OP2_SQL, "op7_decontaminate": decontaminate.OP7_SQL, "op12_substrings": substrings.OP12_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
