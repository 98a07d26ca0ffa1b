"""Chat formatting with quotation linking (operator 8).

Messages quote earlier ones in lines that begin with >, nested as deep as there are signs.  Quoted passages are cut out, their sentences are normalised,
hashed and joined with the messages' own sentences; the message that first said the whole passage is its original, else the one that first said most of it.  A message answers the
original it quotes, else the message before it, and conversations come out in reply order: a quoted message, then the replies to it, then what followed.

Hashes are joined by (conversation, hash) and originals are first occurrences, merged map-side; order inside a conversation is found over range slices.
So a conversation or a sentence may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusloom.llm.common import query, stored
from corpusloom.plans.ordered import numbered

QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r".{0,200}\b(?:wrote|said|schrieb|a écrit|escribió)\s*:\s*")
SENTENCE = re.compile(r"(?<=[.!?])\s+")

PARSED = "conv_id long, turn long, role string, own string, units array<string>, quotes array<struct<level:int,at:int,units:array<string>>>"


def units_of(lines: list[str]) -> list[str]:
    """Hashes of the sentences of a passage: lines joined, white space collapsed, case folded."""
    text = " ".join(" ".join(lines).split()).casefold()
    return [hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest() for s in SENTENCE.split(text) if s]


def parse(text: str) -> tuple[str, list[str], list[tuple[int, int, list[str]]]]:
    """Own text, hashes of its sentences, and quotes as (level, place, hashes).

    A quote is a run of lines of one level.  A line that only says who wrote what follows goes with the quote.
    """
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    level = 0
    for line in text.split("\n"):
        m = QUOTE.match(line)
        now = m.group(1).count(">") if m else 0
        if not now:
            own.append(line)
        else:
            if now != level:
                quotes.append((now, []))
                while level == 0 and own and (not own[-1].strip() or ATTRIBUTION.fullmatch(own[-1])):
                    own.pop()
            quotes[-1][1].append(line[m.end():])
        level = now
    if not quotes:
        return text, units_of(own), []
    return "\n".join(own).strip("\n"), units_of(own), [(lv, k, units_of(lines)) for k, (lv, lines) in enumerate(quotes)]


def parsed(conversations: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [parse(t or "") for t in b.column(3).to_pylist()]
            quote = pa.list_(pa.struct([("level", pa.int32()), ("at", pa.int32()), ("units", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string())),
                 pa.array([[dict(zip(("level", "at", "units"), q)) for q in g[2]] for g in got], quote)],
                names=["conv_id", "turn", "role", "own", "units", "quotes"])

    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, PARSED)


def whole(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, at, whole: the first earlier turn that says all sentences of a passage in one run; passages of one sentence are left to the votes.

    A message is cut into runs only of the lengths that passages of its conversation have.
    """
    run = lambda units: F.md5(F.array_join(units, ","))
    asked = messages.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.at", "q.units").filter(F.size("units") > 1)
    asked = asked.select("conv_id", "turn", "level", "at", F.size("units").alias("_n"), run(F.col("units")).alias("_run"))
    lengths = asked.select(F.col("conv_id").alias("_c"), "_n").distinct()
    own = messages.select("conv_id", "turn", "units").join(lengths, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.size("units") >= F.col("_n")))
    starts = F.sequence(F.lit(1), F.size("units") - F.col("_n") + 1)
    first = (own.select("conv_id", "turn", F.explode(F.transform(starts, lambda i: run(F.slice("units", i, F.col("_n"))))).alias("_u"))
             .groupBy("conv_id", "_u").agg(F.min("turn").alias("said")).withColumnRenamed("conv_id", "_c"))
    met = asked.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_run") == F.col("_u"))).filter("said < turn")
    return met.groupBy("conv_id", "turn", "level", "at").agg(F.min("said").alias("whole"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_linked, reply_to for every turn with a linked quote.

    A passage goes to the first earlier turn that says it whole.  Of other passages, each sentence goes to the first turn of the conversation that says it, if it comes before
    the quoting turn, and the passage to the turn that said most of it so, the later one on a tie; a message answers the original of its outermost linked passage.
    """
    first = messages.select("conv_id", "turn", F.explode("units").alias("unit")).groupBy("conv_id", "unit").agg(F.min("turn").alias("said"))
    first = first.select(F.col("conv_id").alias("_c"), F.col("unit").alias("_u"), "said")
    asked = messages.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.at", F.explode("q.units").alias("unit"))
    met = asked.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("unit") == F.col("_u"))).filter("said < turn")
    votes = met.groupBy("conv_id", "turn", "at", "level", "said").agg(F.count("*").alias("n"))
    quotes = votes.groupBy("conv_id", "turn", "at", "level").agg(F.max_by("said", F.struct("n", "said")).alias("said"))
    runs = whole(messages).withColumnsRenamed({c: f"_{c}" for c in ("conv_id", "turn", "level", "at")})
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("turn") == F.col("_turn")) & (F.col("level") == F.col("_level")) & (F.col("at") == F.col("_at"))
    quotes = quotes.join(runs, same, "left").withColumn("said", F.coalesce("whole", "said"))
    return quotes.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min_by("said", F.struct("level", -F.col("said"))).alias("reply_to"))


def anchors(turns: DataFrame) -> DataFrame:
    """conv_id, turn, anchor: the message whose replies the turn is among; null in the main thread.

    A turn that answers another than the one before it opens a branch, and the turns after it stay in the branch.
    The last opening is carried through range slices: inside a slice by a running window, between slices by one row per (slice, conversation).
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    branch = F.when(F.col("reply_to").isNotNull() & (F.col("reply_to") != F.col("turn") - 1), F.struct("turn", "reply_to"))
    s = stored(turns.repartitionByRange(parts, "conv_id", "turn").withColumn("_slice", F.spark_partition_id())
               .select("_slice", "conv_id", "turn", branch.alias("_open")), "slices")
    running = W.partitionBy("_slice", "conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    local = s.withColumn("_here", F.last("_open", ignorenulls=True).over(running))
    per = s.groupBy("_slice", "conv_id").agg(F.max("_open").alias("_last"))
    before = W.partitionBy("conv_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = (per.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).filter("_carry is not null")
             .select(F.col("_slice").alias("_cs"), F.col("conv_id").alias("_cc"), "_carry"))
    joined = local.join(carry, (F.col("_slice") == F.col("_cs")) & F.col("conv_id").eqNullSafe(F.col("_cc")), "left")
    return joined.select("conv_id", "turn", F.coalesce("_here", "_carry")["reply_to"].alias("anchor"))


def paths(anchored: DataFrame) -> DataFrame:
    """conv_id, turn, path: the turns from the main thread down to this one.  Ancestors double with every step."""
    state = stored(anchored.select("conv_id", "turn", F.col("anchor").alias("up"), F.array("turn").alias("path")), "paths")
    while not (todo := state.filter("up is not null")).isEmpty():
        above = state.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        step = todo.join(above, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("up") == F.col("_t")), "left")
        step = step.select("conv_id", "turn", F.col("_up").alias("up"), F.concat(F.coalesce("_path", F.array().cast("array<bigint>")), "path").alias("path"))
        state = stored(step.unionByName(state.filter("up is null")), "paths")
    return state.select("conv_id", "turn", "path")


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """Every message without its quotes: conv_id, turn, role, text, n_quotes, n_linked, reply_to, depth, place, chat.

    ``place`` numbers a conversation's turns in reply order from 1; ``chat`` is the message in chat markup.  Null texts are empty messages; a null turn comes before all others,
    rows of one conversation and turn share their place, and rows without a conversation are one conversation.  An empty table gives an empty result.
    """
    messages = stored(parsed(conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", "text")), "messages", compression="zstd")
    found = links(messages).select(F.col("conv_id").alias("_lc"), F.col("turn").alias("_lt"), "n_linked", "reply_to")
    same = F.col("conv_id").eqNullSafe(F.col("_lc")) & (F.col("turn") == F.col("_lt"))
    turns = messages.select("conv_id", "turn").distinct().join(found, same, "left").select("conv_id", "turn", "n_linked", "reply_to")
    turns = stored(turns, "turns")
    placed = numbered(paths(anchors(turns)).join(turns.withColumnsRenamed({"conv_id": "_lc", "turn": "_lt"}), same).drop("_lc", "_lt"), ["conv_id"], ["path"], "place")
    placed = placed.withColumnsRenamed({"conv_id": "_lc", "turn": "_lt"})
    out = messages.join(placed, same)
    previous = F.when(F.col("turn") > 0, F.col("turn") - 1)
    return out.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                      F.coalesce("reply_to", previous).alias("reply_to"), (F.size("path") - 1).alias("depth"), F.col("place").cast("long").alias("place"),
                      F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("\n")).alias("chat"))


@query("op8_quotation_linking")
def op8_quotation_linking(spark, sf_dir):
    return linked_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
