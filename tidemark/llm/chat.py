"""Reply trees to training conversations. Built-in functions only.

Messages name their parent. Self-joins with doubling reach (1, 2, 4 ... parents up) carry every
message to its root with the sum of scores on the way: a tree of depth d takes log2(d) rounds.
Leaves rank the branches of their tree by mean score; the chosen paths are walked back through
the same jump tables, which visits each message of a path exactly once, and each path becomes one
formatted conversation with a loss mask over its assistant texts.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. A control string inside a text
gets one backslash after its first character, and one that has backslashes there gets one more, so removing one
restores the text. Roles additionally write % and line feed as %25 and %0A.

Defined results: null role or text is empty; a message whose parent is missing is a root; messages on a
cycle hang on no root and belong to no path; of repeated (tree, id) rows the greatest (by parent, role, text, score) is the message; ties between branches go to
the deeper, then to the smaller leaf id; an empty table gives an empty result; a null tree is a tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import materialise

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Strings that common chat templates treat as control, as (first character, rest).
_CONTROL = ((r"<", r"\|im_(?:start|end)\|>|/?s>"), (r"\[", r"/?INST\]"))


def escape(text: Column) -> Column:
    for first, rest in _CONTROL:
        text = F.regexp_replace(text, rf"({first})(\\*)({rest})", r"$1\\$2$3")
    return text


def unescape(text: Column) -> Column:
    for first, rest in _CONTROL:
        text = F.regexp_replace(text, rf"({first})\\(\\*)({rest})", "$1$2$3")
    return text


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def jump_tables(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, id, size, up, total, depth): the k-th leads 2**k messages up (null above the root).

    A tree of `size` messages is no deeper than that, so the k-th table holds only trees of more than
    2**(k-1): one long conversation costs more rounds for itself, not for all.
    """
    sizes = nodes.groupBy(F.col("tree").alias("t")).agg(F.count(F.lit(1)).alias("size"))
    parents = nodes.select(F.col("tree").alias("t"), F.col("id").alias("p"))
    known = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left").drop("t")
    sized = known.join(sizes, F.col("tree").eqNullSafe(F.col("t")))
    tables = [materialise(sized.select("tree", "id", "size", F.col("p").alias("up"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("depth")), "jump")]
    largest = tables[0].agg(F.max("size")).first()[0] or 0
    while largest > 1 << (len(tables) - 1):
        now = tables[-1].where(F.col("size") > 1 << (len(tables) - 1))
        above = now.select(F.col("tree").alias("t"), F.col("id").alias("p"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("steps"))
        further = now.where("up IS NOT NULL").join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("p"))).select(
            "tree", "id", "size", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("steps")).alias("depth")
        )
        tables.append(materialise(further.unionByName(now.where("up IS NULL")), "jump"))
    return tables


def chosen_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, rank, branch_score, place, role, text) for the best `per_tree` branches of each tree.

    `messages`: tree, id, parent, role, text, score.
    """
    # Of repeated rows the greatest: the same one each time this is evaluated.
    once = messages.groupBy("tree", "id").agg(F.max(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "id", "m.*")
    nodes = materialise(once.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
    tables = jump_tables(nodes)
    # Each tree is read from the table that completes it; what is open there hangs on a cycle.
    ends = reduce(DataFrame.unionByName, (t.where((F.col("size") <= 1 << k) & F.col("up").isNull()) for k, t in enumerate(tables)))
    inner = tables[0].where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = ends.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")), "left_anti")
    best = W.partitionBy("tree").orderBy(F.desc("branch_score"), F.desc("depth"), "id")
    ranked = (
        leaves.select("tree", "id", "depth", (F.col("total") / F.col("depth")).alias("branch_score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= per_tree)
    )
    path = ranked.select("tree", F.col("id").alias("leaf"), "rank", "branch_score", F.col("depth").alias("place"), F.col("id").alias("at"))
    for k in reversed(range(len(tables) - 1)):
        jump = tables[k].where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("id").alias("p"), "up")
        hop = path.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("p")))
        path = path.unionByName(hop.select("tree", "leaf", "rank", "branch_score", (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("at")))
        if k:
            path = materialise(path, "path")
    texts = once.select(F.col("tree").alias("t"), F.col("id").alias("p"), "role", "text")
    return path.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("p"))).drop("t", "p", "at")


def format_turns(turns: DataFrame, keys: list[str], place: str) -> DataFrame:
    """`keys`, formatted, loss (array of start, end in code points) from (keys, place, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    head = turns.select(
        *keys, F.col(place).alias("__place"),
        F.concat(F.lit(START), _role_out(role), F.lit("\n")).alias("head"), escape(text).alias("body"),
        (role == LOSS_ROLE).alias("trained"),
    )
    piece = F.concat("head", "body", F.lit(END + "\n"))
    before = W.partitionBy(*keys).orderBy("__place").rowsBetween(W.unboundedPreceding, -1)
    cut = head.select(
        *keys, "__place", piece.alias("piece"), "trained", F.length("head").cast("bigint").alias("h"), F.length("body").cast("bigint").alias("b")
    ).withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("h"))
    turn = F.struct("__place", "piece", "trained", "at", (F.col("at") + F.col("b")).alias("to"))
    return cut.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(
        *keys,
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["at"].alias("start"), t["to"].alias("end"))).alias("loss"),
    )


def format_conversations(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree, leaf, rank, branch_score, formatted, loss."""
    return format_turns(chosen_paths(messages, per_tree), ["tree", "leaf", "rank", "branch_score"], "place")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    cut = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    tail = len(END) + 1

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - tail)
        return F.struct(_role_in(role).alias("role"), unescape(text).alias("text"))

    return F.transform(cut, turn)


def loss_text(formatted: Column, loss: Column | str) -> Column:
    """All text under the mask, escapes undone."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def as_messages(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each turn answers the one before."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.withColumn("id", F.row_number().over(order).cast("bigint")).select(
        F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text",
        F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"),
    )
