"""The corpus operators as named queries over the given tables, and SQL checks where SQL can express them."""

from moodspark.llm import (
    chat, decontamination, fingerprints, language_model, line_dedup, ngram_join, packing, pii, quality, repair, runs, toxicity, warc,
)
from moodspark.llm.common import read

LLM_QUERIES = {}
LLM_ORACLES = {"op1_chat_formatting": chat.FORMAT_SQL, "op3_warc": warc.ARCHIVE_SQL}


def query(run):
    LLM_QUERIES[run.__name__] = run
    return run


@query
def op1_chat_formatting(spark, sf):
    return chat.format_chats(read(spark, sf, "conversations"))


@query
def op2_decontamination(spark, sf):
    return decontamination.find_contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query
def op3_warc(spark, sf):
    return warc.archive_pages(read(spark, sf, "pages"))


@query
def op4_fingerprints(spark, sf):
    return fingerprints.fingerprint_documents(read(spark, sf, "documents"))


@query
def op5_best_fit_packing(spark, sf):
    import public_tokenizers

    return packing.pack_documents(
        read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


@query
def op6_personal_data(spark, sf):
    return pii.find_personal_data(read(spark, sf, "documents"))


@query
def op7_quality(spark, sf):
    return quality.score_quality(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query
def op8_line_dedup(spark, sf):
    return line_dedup.dedup_lines(read(spark, sf, "documents"))


@query
def op9_ngram_join(spark, sf):
    return ngram_join.near_duplicates(read(spark, sf, "documents"))


@query
def op10_toxicity(spark, sf):
    return toxicity.score_toxicity(read(spark, sf, "documents"), read(spark, sf, "labels")).drop("raw")


@query
def op11_structure_repair(spark, sf):
    return repair.repair_conversations(repair.damaged(read(spark, sf, "conversations")))


@query
def op12_periodic_runs(spark, sf):
    return runs.describe_runs(runs.periodic_runs(read(spark, sf, "documents"), runs.planted_tails))


@query
def op13_language_model(spark, sf):
    return language_model.score_language(read(spark, sf, "documents"))
