"""Documents told apart by SpotSigs: what follows their common words.

Each run of common words (anchors) and the three content words behind it form a
signature; a document is the set of its signatures.  Boilerplate has few
common words and so leaves few signatures.  Sets are compared by Jaccard
likeness; sets whose sizes differ too much cannot be alike and are never
compared, since they are partitioned by size.  All of it is built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedlift.llm.common import read_table, row_hash, text_or_empty, written

# Common words of English, German, French and Spanish; fixed values.
ANCHORS = (
    "a an and are as at be by for from had has have he her his in is it not of on or that the "
    "this to was were which with "
    "als am auf aus das dem den der des die ein eine einen einer es für ich im ist mit nicht sich "
    "sie und von war wie zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il je la le les mais ne ou par pas pour "
    "que qui sa se son sur un une "
    "al como con del el ella está fue la las lo los más no para pero por se sin su una y"
).split()
CHAIN = 3
NEAR = 0.8
# Documents that are brought together in one task to find each one's next, on average.
RUN_ROWS = 4_000
MOST_RUNS = (1 << 14) - 1


def _once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """A column that later lambdas read instead of computing it for each element."""
    return df.select("*", F.explode(F.array(expression)).alias(name))


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sorted set of a text's signatures.

    A text without any anchor is taken by all its chains; one without a word has none.
    """
    words = F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")
    df = _once(df, "_words", words)
    anchors = ", ".join(f"'{word}'" for word in dict.fromkeys(ANCHORS))
    # Anchors are glued to the content word behind them, so that an element is one content word.
    glued = f"transform(_words, w -> if(w IN ({anchors}), concat(w, '~'), concat(w, ' ')))"
    df = _once(df, "_spots", F.split(F.rtrim(F.array_join(F.expr(glued), "")), " "))
    df = _once(df, "_content", F.expr("transform(_spots, s -> substring_index(s, '~', -1))"))
    behind = ", ".join(f"slice(_content, {n + 1}, size(_content))" for n in range(1, CHAIN))
    df = _once(df, "_chains", F.expr(f"slice(arrays_zip(_spots, {behind}), 1, size(_spots))"))
    fields = ", ".join(["c._spots", *(f"c.`{n}`" for n in range(1, CHAIN))])
    spotted = "filter(_chains, c -> instr(c._spots, '~') > 0)"
    df = _once(df, "_spotted", F.expr(spotted))
    chosen = "if(size(_spotted) > 0, _spotted, if(size(_words) = 0, array(), _chains))"
    signatures = F.expr(f"array_sort(array_distinct(transform({chosen}, c -> hash({fields}))))")
    df = df.withColumn(name, signatures)
    return df.drop("_words", "_spots", "_content", "_chains", "_spotted")


def as_text(signatures: str) -> Column:
    """A set of signatures as text: eight hexadecimal digits each, in order."""
    digits = F.expr(f"transform({signatures}, s -> lpad(lower(hex(s & 4294967295L)), 8, '0'))")
    return F.array_join(digits, "")


def jaccard(one: str, two: str) -> Column:
    """Likeness of two sets, 1 for two empty ones.  Without a common bound no intersection."""
    both = F.size(F.array_intersect(one, two))
    either = F.size(one) + F.size(two)
    like = F.when(F.least(F.size(one), F.size(two)) == 0, 0.0).otherwise(both / (either - both))
    return F.when(either == 0, 1.0).otherwise(like)


def near_pairs(sets: DataFrame, near: float = NEAR) -> DataFrame:
    """Pairs ``u`` < ``v`` of sets at least ``near`` alike, and their ``likeness``.

    ``sets`` has ``set_id`` and ``signatures``, an array, with equal sets given
    once.  Sets are partitioned by size: alike ones are in the same or a
    neighbouring partition.  Within it they meet by the rarest signatures of
    which alike sets share at least one; so a common signature brings none together.
    Empty sets have no pairs.
    """
    rows = sets.where(F.size("signatures") > 0)
    size = F.size("signatures").alias("n")
    each = rows.select("set_id", size, F.explode("signatures").alias("s"))
    counts = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(counts, "s").groupBy("set_id", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "s"))).alias("by_df")
    )
    prefix = (F.col("n") - F.ceil(F.col("n") * near - 1e-9) + 1).cast("int")
    partition = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / near) + 1e-9)
    rarest = F.explode(F.slice("by_df.s", F.lit(1), prefix)).alias("s")
    rare = written(ranked.select("set_id", "n", partition.alias("p"), rarest), "op7-rare")
    one = rare.select(F.col("set_id").alias("u"), F.col("n").alias("n_u"), "p", "s")
    two = rare.select(
        F.col("set_id").alias("v"),
        F.col("n").alias("n_v"),
        F.explode(F.array("p", F.col("p") + 1)).alias("p"),
        "s",
    )
    meets = one.join(two, ["p", "s"]).where(
        (F.col("u") != F.col("v"))
        & (F.col("n_u") * near <= F.col("n_v") + 1e-9)
        & (F.col("n_v") * near <= F.col("n_u") + 1e-9)
    )
    pairs = meets.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a = rows.select(F.col("set_id").alias("u"), F.col("signatures").alias("a"))
    b = rows.select(F.col("set_id").alias("v"), F.col("signatures").alias("b"))
    checked = pairs.join(a, "u").join(b, "v").withColumn("likeness", jaccard("a", "b"))
    return checked.where(F.col("likeness") >= near).select("u", "v", "likeness")


def _run_of(bounds: list[int]) -> Column:
    """The number of ``bounds``, which are sorted, below an id; -1 for none: binary search."""
    if not bounds:
        place = F.lit(0)
    else:
        steps = [1 << bit for bit in reversed(range(len(bounds).bit_length()))]
        listed = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
        further = f"low + step <= {len(bounds)} AND get({listed}, low + step - 1) < doc_id"
        place = F.expr(
            f"aggregate(array({', '.join(map(str, steps))}), 0, "
            f"(low, step) -> if({further}, low + step, low))"
        )
    return F.when(F.col("doc_id").isNull(), -1).otherwise(place)


def with_next(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds ``next_<column>``: its value in the next row by descending ``doc_id``, cyclically.

    Rows that share an id follow each other by ``text_key``; rows without an id
    come last.  Ids are cut into runs of some thousand rows, each sorted in a task
    of its own; a run also gets a copy of the row that follows its last one.
    """
    ids = rows.select("doc_id")
    total = ids.count()
    runs = max(1, min(MOST_RUNS, total // RUN_ROWS))
    bounds: list[int] = []
    if runs > 1:
        shares = [i / runs for i in range(1, runs)]
        cuts = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * runs)).alias("c"))
        bounds = sorted(set(cuts.first()["c"] or []))
    placed = rows.withColumn("_run", _run_of(bounds))
    # One row for each run: its first id, and the run that ends before it.
    heads = ids.withColumn("_run", _run_of(bounds)).groupBy("_run")
    found = sorted(heads.agg(F.max("doc_id").alias("_head")).collect())
    after = found[1:] + found[:1]
    above = [(*row, before["_run"]) for row, before in zip(found, after, strict=True)]
    table = rows.sparkSession.createDataFrame(above, "_head_run int, _head long, _before int")
    met = (F.col("_run") == F.col("_head_run")) & F.col("doc_id").eqNullSafe(F.col("_head"))
    # At most MOST_RUNS + 2 rows of three numbers.
    marked = placed.join(F.broadcast(table), met, "left")
    own = F.struct(F.lit(False).alias("extra"), F.col("_run").alias("run"))
    copy = F.struct(F.lit(True).alias("extra"), F.col("_before").alias("run"))
    places = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy))
    marked = marked.withColumn("_place", F.explode(places)).select(
        *rows.columns, F.col("_place.run").alias("_run"), F.col("_place.extra").alias("_extra")
    )
    falling = [F.col(name).desc_nulls_last() for name in ("doc_id", "text_key")]
    along = Window.partitionBy("_run").orderBy("_extra", *falling)
    out = marked.withColumns({f"next_{name}": F.lead(name).over(along) for name in columns})
    return out.where(~F.col("_extra")).drop("_run", "_extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``text`` and ``signatures`` for every row of ``docs``.

    A null text is empty and has no signatures; repeated rows get equal ones; other
    columns of ``docs`` are not looked at.
    """
    rows = docs.select("doc_id", row_hash().alias("text_key"), text_or_empty().alias("text"))
    return with_signatures(rows, "text", "signatures")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts, of the texts with their last third replaced, and likenesses."""
    prints = fingerprints(read_table(spark, sf_dir, "documents"))
    rows = with_next(prints, "text", "signatures")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    kept = F.substring("text", F.lit(1), n - cut)
    edited = F.concat(kept, F.substring("next_text", F.lit(1), cut))
    rows = with_signatures(rows.withColumn("edited", edited), "edited", "edited_signatures")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("signatures").alias("fingerprint"),
        as_text("edited_signatures").alias("edited_fingerprint"),
        jaccard("signatures", "edited_signatures").alias("near_edited"),
        jaccard("signatures", "next_signatures").alias("near_next"),
    )
