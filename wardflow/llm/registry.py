"""The queries of this subpackage and, where SQL can express them, their DuckDB form."""

from wardflow.llm import avi, chat, compaction, language_id, line_crf, line_dedup, mixing, pieces, quality_rules, secrets, simhash, vector_codes, warc

QUERIES = {
    "op1_quality_classifier": line_crf.op1_quality_classifier,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_simhash": simhash.op4_simhash,
    "op6_warc": warc.op6_warc,
    "op7_media_columns": avi.op7_media_columns,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "lattice_best_path": pieces.lattice_best_path,
    "op9_secrets": secrets.op9_secrets,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op11_language_id": language_id.op11_language_id,
    "op12_compaction": compaction.op12_compaction,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op6_warc": warc.OP6_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
