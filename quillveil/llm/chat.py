"""Chat formatting of reply trees, in DataFrame functions alone.

Messages name their parents. Self-joins that double their reach enumerate root-to-leaf paths (of n messages on the
longest path, about 2 log2 n joins), branches are ranked by the sum of their messages' scores, and each chosen path is
formatted as one conversation with the spans that count towards the loss.

A turn is written as `### role: text </turn>` and a newline. Within texts and roles a backslash is doubled, `<` becomes
`\\l` and `#` becomes `\\h` (in roles also `:` becomes `\\c`), so no text can hold a control string and all are read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
ESCAPES = (("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escaped(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(text, [("\\", "\\\\"), *pairs])


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    """Doubled backslashes, taken from the left, part the text; in the parts each escape stands for itself alone."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: _replaced(p, [(b, a) for a, b in pairs])), "\\")


def linear(turns: DataFrame) -> DataFrame:
    """Reply trees without branches: each row of (conv_id, turn, role, text) answers the one before it.

    Rows of equal turns follow each other by role and text, nulls first; repeated rows stay.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(w).cast("long"))
    return rows.select("conv_id", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _once(messages: DataFrame, *values: str) -> DataFrame:
    """One row of each message: the least of repeated ones. Fewer values choose the same row as long as they are the first."""
    rows = messages.groupBy("conv_id", "message").agg(F.min(F.struct(*values)).alias("v"))
    return rows.select("conv_id", "message", *(F.col("v")[name].alias(name) for name in values))


def _named(df: DataFrame, conv_id: str, message: str) -> DataFrame:
    return df.withColumnsRenamed({"conv_id": conv_id, "message": message})


def paths(messages: DataFrame, scratch: str, best: int = 1) -> DataFrame:
    """(conv_id, leaf, path, score, rank): the `best` root-to-leaf paths of each conversation.

    `path` holds message ids from root to leaf. Branches rank by the sum of their messages' scores (null: 0), highest
    first, then by leaf id. A message whose parent isn't there is a root. Messages on a cycle, or below one, are on no path.
    Repeated messages are one, the least by parent, score, role and text. An empty table gives no paths.

    Table k has each message's 2^k-th ancestor and the score up to it, so that its size doesn't depend on the paths' length;
    only the chosen leaves' ancestors are then listed, from the highest table down: each join doubles the list.
    """
    nodes = stored(_once(messages, "parent", "score"), f"{scratch}/messages")
    above = _named(nodes.select("conv_id", "message"), "c", "m")
    sizes = nodes.groupBy(F.col("conv_id").alias("s")).agg(F.count("*").alias("size"))
    tree = nodes.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("m")), "left").join(sizes, F.col("conv_id").eqNullSafe(F.col("s")))
    tree = tree.select("conv_id", "message", F.col("m").alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"), "size")
    tables: list[DataFrame] = []
    while True:
        reach = 1 << len(tables)
        # A path that reaches further than its conversation has messages is on a cycle.
        tables.append(stored(tree.where(F.col("up").isNull() | (F.col("size") > reach)), f"{scratch}/ancestors-{reach}"))
        open_ = tables[-1].where("up IS NOT NULL")
        if open_.isEmpty():
            break
        above = _named(tables[-1].select("conv_id", "message", F.col("up").alias("up2"), F.col("score").alias("score2")), "c", "m")
        joined = open_.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("m")))
        joined = joined.select("conv_id", "message", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), "size")
        tree = tables[-1].where("up IS NULL").unionByName(joined)
    inner = _named(tables[0].where("up IS NOT NULL").select("conv_id", F.col("up").alias("message")).distinct(), "c", "m")
    leaves = tables[-1].join(inner, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m")), "left_anti")
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "message")
    chosen = leaves.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)
    listed = stored(chosen.select("conv_id", "message", F.col("message").alias("leaf"), "score", "rank", F.lit(0).alias("back")), f"{scratch}/listed")
    for k in reversed(range(len(tables) - 1)):
        above = _named(tables[k].where("up IS NOT NULL").select("conv_id", "message", "up"), "c", "m")
        more = listed.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m")))
        more = more.select("conv_id", F.col("up").alias("message"), "leaf", "score", "rank", (F.col("back") + (1 << k)).alias("back"))
        listed = stored(listed.unionByName(more), f"{scratch}/listed-{k}")
    steps = F.sort_array(F.collect_list(F.struct("back", "message")), asc=False)
    return listed.groupBy("conv_id", "leaf", "score", "rank").agg(steps.alias("steps")).select("conv_id", "leaf", F.col("steps.message").alias("path"), "score", "rank")


def formatted(messages: DataFrame, chosen: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, leaf, formatted, loss): each path as one text; `loss` has the code point spans of the role's escaped texts.

    Null roles and texts count as empty. Of repeated messages the one that `paths` takes is written. No paths give no rows;
    columns of other names are left out.
    """
    texts = _named(_once(messages, "parent", "score", "role", "text"), "c", "m")
    steps = chosen.select("conv_id", "leaf", F.posexplode("path").alias("at", "step"))
    rows = steps.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("step") == F.col("m")))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select("conv_id", "leaf", "at", (role == loss_role).alias("is_loss"), escaped(role, ROLE_ESCAPES).alias("role"), escaped(text).alias("text"))
    ahead, behind = F.length("role") + (len(HEAD) + len(MIDDLE)), F.length("text") + len(TAIL)
    before = Window.partitionBy("conv_id", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(ahead + behind).over(before), F.lit(0)) + ahead).cast("int")
    span = F.struct(start.alias("start"), (start + F.length("text")).alias("end"))
    turn = F.struct("at", "is_loss", span.alias("span"), F.concat(F.lit(HEAD), "role", F.lit(MIDDLE), "text", F.lit(TAIL)).alias("written"))
    turns = turns.select("conv_id", "leaf", turn.alias("turn")).groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["is_loss"]), lambda t: t["span"])
    return turns.select("conv_id", "leaf", F.array_join("turns.written", "").alias("formatted"), loss.alias("loss"))


def read_back(text: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.split(text, TAIL, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, MIDDLE, 1)
        rest = F.substr(p, F.length(role) + len(MIDDLE) + 1)
        return F.struct(unescaped(F.substr(role, F.lit(len(HEAD) + 1)), ROLE_ESCAPES).alias("role"), unescaped(rest).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), "")
