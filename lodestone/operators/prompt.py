"""Prompts for a generator: the rules, the question and the packed blocks, within a token budget as a whole.

Which marker stands for which chunk travels as a column; nothing is read back out of the prose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import GenerationConfig
from lodestone.functions import text as X
from lodestone.operators import answer as A
from lodestone.operators.stage import staged

#: Fixed value: what a generator says if the blocks don't hold the answer.
SENTINEL = "INSUFFICIENT_CONTEXT"
SYSTEM = f"Answer from the numbered blocks alone. End every statement with the marker of its block, as in [1]; use only markers that are there. Give values as they stand: don't compute or convert. If the blocks don't hold the answer, say {SENTINEL} and nothing else. Be brief."
#: Fixed value: tokens kept free for merges where parts meet.
PAD = 8
ROUNDS = 4


def _text(question: Column, blocks: Column) -> Column:
    return F.concat(F.lit(SYSTEM + "\n\nQuestion: "), F.trim(question), F.lit("\n\nBlocks:\n"), blocks, F.lit(f"\n\nAnswer with markers, or {SENTINEL}."))


def overhead(question: Column) -> Column:
    """Tokens of everything but the blocks."""
    return X.count_tokens(_text(question, F.lit(""))) + PAD


def build(questions: DataFrame, packed: DataFrame) -> DataFrame:
    """(qid, prompt, markers): blocks in the order of their markers; markers maps each to its chunk."""
    shown = A.block(F.col("marker"), {c: F.col(c) for c in ("pk", "table", "source_id", "kind", "score", "body")})
    own = packed.select("qid", F.struct("marker", shown.alias("text"), "chunk_id").alias("b")).groupBy("qid").agg(F.array_sort(F.collect_list("b")).alias("b"))  # as many as fit a prompt
    blocks = F.array_join(F.transform("b", lambda x: x["text"]), "\n\n")
    markers = F.map_from_entries(F.transform("b", lambda x: F.struct(x["marker"], x["chunk_id"])))
    return questions.join(own, "qid", "left").select("qid", _text(F.col("text"), F.coalesce(blocks, F.lit(""))).alias("prompt"), F.coalesce(markers, F.create_map().cast("map<int," + packed.schema["chunk_id"].dataType.simpleString() + ">")).alias("markers"))


def fitted(questions: DataFrame, hits: DataFrame, config: GenerationConfig = GenerationConfig()) -> tuple[DataFrame, DataFrame]:
    """(packed, prompts) within max_prompt_tokens as a whole.

    What isn't context is reserved first. Prompts that are measured too long all the same reserve their excess more and are
    packed again, ROUNDS times at most; those that have no block left stay as they are.
    """
    asked = questions.select("qid", "text", overhead(F.col("text")).alias("reserve"))
    for n in range(ROUNDS + 1):
        packed = staged(A.pack(hits.join(asked.select("qid", "reserve"), "qid"), config, F.col("reserve")).drop("reserve"))
        made = staged(build(asked, packed))
        if n == ROUNDS:
            break
        long_ = made.select("qid", (X.count_tokens(F.col("prompt")) - config.max_prompt_tokens).alias("over"), (F.size("markers") > 0).alias("some")).where("over > 0 and some")
        if long_.isEmpty():
            break
        asked = staged(asked.join(long_.select("qid", "over"), "qid", "left").select("qid", "text", (F.col("reserve") + F.coalesce("over", F.lit(0))).alias("reserve")))
    return packed, made


def refused(reply: Column) -> Column:
    """Whether a generator's reply is the sentinel."""
    return reply.rlike(rf"^\s*{SENTINEL}\s*$")
