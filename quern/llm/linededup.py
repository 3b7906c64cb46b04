"""Operator 8: line dedup by log templates.

A line's place in the tree is its number of tokens and its leading tokens, after
tokens with a digit have become a wildcard. In that leaf a line belongs to several
templates: its whole token sequence, and, if it is long enough, the sequence with any
one of its quarters left open, so that lines that differ in one field share a template
wherever the field is. A template is a 64-bit hash. Templates that recur in several
documents are boilerplate, and their lines are dropped from every document.

Copies are the exception that ``copy`` switches on: a document most of whose words lie
in recurring lines may be a copy of others rather than a carrier of boilerplate. Each
template has a hub, of its carriers the one whose templates recur most, and a document
is a copy of the hub with which it shares most words, if those are most words of the two
together; what follows hubs to one end is a class. A copy keeps the lines whose
recurrence its class explains, for near-duplicate detection to judge: its class has most
of a template's documents, or too few other bodies have it, a class being one body. It
loses the others. Otherwise groups of copies would lose all their members' lines.

DataFrame functions only. Texts are parsed once, equal texts are one row with a count
after that, and templates are counted with a map-side combine, so a line or a text that a
third of all documents share sends one row from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import SPACE_RUN, SPACES, durable, nested

#: Leading tokens that a template always has; tokens below which a line has none; tokens
#: from which a quarter may be open.
DEPTH, LEAST, OPEN = 2, 3, 8
#: Documents from which a template recurs.
DOCUMENTS = 3
#: For a caller whose copies go to near-duplicate detection next: the share of a
#: document's words in recurring lines above which it may be a copy, and of the words of
#: two documents in lines they share above which they are copies.
COPY = 0.6
#: From a token's start; the possessive run keeps long tokens linear.
VARIABLE = "(?<!\\S)[^\\s\\d]*+\\d\\S*"

_BARE = f"btrim(line, '{SPACES}')"
_QUARTER = "xxhash64(slice(t, size(t) * {0} div 4 + 1, size(t) * ({0} + 1) div 4 - size(t) * {0} div 4))"
#: From lines: (words, templates) of each. Few lines have a digit, so the costly pattern is
#: tried on those alone; a quarter is hashed once, and templates are hashes of its hashes.
_TEMPLATES = f"""
transform(lines, raw -> transform(array(CASE WHEN raw RLIKE '[0-9]' THEN regexp_replace(raw, '{VARIABLE}', '<*>') ELSE raw END), line ->
  transform(array(CASE WHEN {_BARE} = '' THEN array() ELSE split({_BARE}, '{SPACE_RUN}') END), t -> named_struct(
    'words', size(t),
    'keys', CASE
      WHEN size(t) < {LEAST} THEN array()
      WHEN size(t) < {OPEN} THEN array(xxhash64(size(t), t))
      ELSE transform(array(named_struct('leaf', xxhash64(size(t), slice(t, 1, {DEPTH})), {", ".join(f"'{c}', {_QUARTER.format(i)}" for i, c in enumerate("abcd"))})), q ->
        array(xxhash64(q.leaf, q.a, q.b, q.c, q.d), xxhash64(q.leaf, 0, q.b, q.c, q.d), xxhash64(q.leaf, 1, q.a, q.c, q.d), xxhash64(q.leaf, 2, q.a, q.b, q.d), xxhash64(q.leaf, 3, q.a, q.b, q.c)))[0]
      END))[0])[0])
""".replace("\\", "\\\\")


def _once(value: Column, use) -> Column:
    """``use(value)``, where ``value`` is computed once for a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _bodies(docs: DataFrame) -> DataFrame:
    """(body, words, lines, rows): a row for each different text; lines are (i, words, keys), those with a template."""
    split = docs.select(_text(F.col("text")).alias("text")).select(F.xxhash64("text").alias("body"), F.split("text", "\n").alias("lines"))
    info = split.select("body", F.expr(_TEMPLATES).alias("info"))
    keyed = F.filter(F.transform("info", lambda x, i: F.struct(i.alias("i"), x["words"].alias("words"), x["keys"].alias("keys"))), lambda x: F.size(x["keys"]) > 0)
    words = F.aggregate("info", F.lit(0), lambda a, x: a + x["words"])
    return info.select("body", words.alias("words"), keyed.alias("lines")).groupBy("body", "words", "lines").agg(F.count("*").alias("rows"))


def _counted(bodies: DataFrame, documents: int) -> DataFrame:
    keys = bodies.select("rows", F.explode(F.array_distinct(F.flatten("lines.keys"))).alias("key"))
    return keys.groupBy("key").agg(F.sum("rows").alias("documents")).where(F.col("documents") >= documents)


def recurring(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(key, documents): the templates found in so many rows of ``docs`` at least."""
    return _counted(_bodies(docs), documents)


def _classes(linked: DataFrame) -> DataFrame:
    """(body, class) of (body, hub): hubs followed to their ends. A hub never weighs less than its body, so there are no cycles."""
    now = durable(linked)
    while True:
        up = now.select(F.col("body").alias("hub"), F.col("hub").alias("top"))
        step = durable(now.join(up, "hub", "left").select("body", F.coalesce("top", "hub").alias("hub"), (F.col("top").isNotNull() & (F.col("top") != F.col("hub"))).alias("moved")))
        now = step.select("body", "hub")
        if step.where("moved").isEmpty():
            return now.withColumnRenamed("hub", "class")


def _kept_of_copies(able: DataFrame, documents: int, copy: float) -> DataFrame:
    """(body, keeps): the bodies that are copies, and the templates that their class explains.

    able: (body, rows, keyed, found), found being (i, words, key, documents) of each
    line and recurring template. A template that mostly bodies carry that can't be
    copies, if they are enough, needs no hub: it recurs outside every class.
    """
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["documents"])
    held = durable(able.select("body", "rows", "keyed", weight.alias("weight"), F.inline("found")))
    carried = held.groupBy("body", "rows", "keyed", "weight", "key", "documents").agg(F.count("*").alias("times"))
    hub = F.max(F.struct("weight", F.col("body").alias("hub"), F.col("keyed").alias("hub_keyed")))
    keys = carried.groupBy("key", "documents").agg(F.sum("rows").alias("able"), hub.alias("h"))
    keys = keys.withColumn("others", F.col("documents") - F.col("able")).where((F.col("others") < documents) | (2 * F.col("others") < F.col("documents")))
    keys = durable(keys.select("key", "others", "h.hub", "h.hub_keyed"))

    # A line that shares any template with the hub counts once.
    shared = held.join(keys.where(F.col("hub").isNotNull()), "key").where("body <> hub").groupBy("body", "keyed", "hub", "hub_keyed", "i").agg(F.max("words").alias("w"))
    shared = shared.groupBy("body", "keyed", "hub", "hub_keyed").agg(F.sum("w").alias("w"))
    linked = shared.where(F.col("w") > copy * (F.col("keyed") + F.col("hub_keyed") - F.col("w"))).groupBy("body").agg(F.max(F.struct("w", "hub"))["hub"].alias("hub"))
    classes = _classes(linked)
    heads = classes.select(F.col("class").alias("body")).distinct()
    classes = classes.unionByName(heads.select("body", F.col("body").alias("class")))
    repeated = able.where("rows > 1").join(classes, "body", "left_anti").select("body", F.col("body").alias("class"))
    classes = durable(classes.unionByName(repeated))

    own = carried.join(classes, "body", "left").select("key", "documents", "rows", F.coalesce("class", "body").alias("class"), F.col("class").isNotNull().alias("copied"))
    own = durable(own.groupBy("key", "documents", "class", "copied").agg(F.sum("rows").alias("own")))
    bodies = own.groupBy("key").agg(F.count("*").alias("classes")).join(keys.select("key", "others"), "key")
    # A copy's own class is one of the classes.
    explained = (2 * F.col("own") > F.col("documents")) | (F.col("others") + F.col("classes") - 1 < documents)
    fine = own.where("copied").join(bodies, "key").where(explained).select("key", "class")
    mine = classes.join(held.select("body", "key").distinct(), "body").join(fine.withColumn("fine", F.lit(True)), ["key", "class"], "left")
    return mine.groupBy("body").agg(F.collect_set(F.when(F.col("fine"), F.col("key"))).alias("keeps"))


def dropped(docs: DataFrame, documents: int = DOCUMENTS, copy: float | None = None) -> DataFrame:
    """(body, bad, is_copy): the numbers of the lines to drop, for each text that has some or is a copy."""
    bodies = durable(_bodies(docs))
    counts = _counted(bodies, documents)
    line = bodies.select("body", "rows", "words", F.explode("lines").alias("line"))
    held = line.select("body", "rows", F.col("words").alias("all"), F.col("line.i").alias("i"), F.col("line.words").alias("words"), F.explode("line.keys").alias("key"))
    found = held.join(counts, "key").groupBy("body", "rows", "all").agg(F.collect_list(F.struct("i", "words", "key", "documents")).alias("found"))
    numbers = F.array_distinct(F.transform("found", lambda x: x["i"]))
    if copy is None:
        return found.select("body", numbers.alias("bad"), F.lit(False).alias("is_copy"))
    lines = F.array_distinct(F.transform("found", lambda x: F.struct(x["i"], x["words"].alias("words"))))
    found = durable(found.withColumn("in_them", F.aggregate(lines, F.lit(0), lambda a, x: a + x["words"])))
    keyed = bodies.select("body", F.aggregate("lines", F.lit(0), lambda a, x: a + x["words"]).alias("keyed"))
    able = found.where(F.col("in_them") > copy * F.col("all"))
    able = durable(able.join(keyed, "body").select("body", "rows", "keyed", "found"))
    kept = _kept_of_copies(able, documents, copy)
    item = found.select("body", F.inline("found"))
    of = kept.select("body", F.explode("keeps").alias("key"), F.lit(True).alias("keeps"))
    # A line goes if any of its templates recurs outside the class.
    bad = item.join(of, ["body", "key"], "left").where("keeps IS NULL").groupBy("body").agg(F.collect_set("i").alias("bad"))
    out = bad.join(kept.select("body", F.lit(True).alias("is_copy")), "body", "full")
    return out.select("body", F.coalesce("bad", F.array().cast("array<int>")).alias("bad"), F.coalesce("is_copy", F.lit(False)).alias("is_copy"))


def deduplicated(docs: DataFrame, documents: int = DOCUMENTS, copy: float | None = None) -> DataFrame:
    """(doc, n_lines, n_dropped, is_copy): the input's rows as ``doc``, with recurring lines gone from its text.

    Input: text, and any other columns, which stay as they are; n_chars, if there, becomes
    the new text's length. n_lines counts lines with a word. Lines are ``\\n``-split; those
    without a word, or with fewer than LEAST tokens, always stay. A null text stays null.
    A very long text is lines like any other's; a very long line is one line. Repeated
    rows count as documents and get equal texts. No rows give no rows. With ``copy``, copies
    keep the lines that their class explains; without it no document is an exception.
    """
    bad = dropped(docs, documents, copy).withColumnRenamed("body", "_body")
    rows = nested(docs).withColumn("body", F.xxhash64(_text(F.col("doc.text"))))
    joined = rows.join(bad, F.col("body") == F.col("_body"), "left")
    text, n = F.col("doc.text"), F.coalesce(F.size("bad"), F.lit(0)).cast("long")
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("bad")), lambda i: F.get(lines, i))
    new = F.when(F.col("n_dropped") > 0, _once(F.split(text, "\n"), lambda lines: F.array_join(kept(lines), "\n"))).otherwise(text)
    counted = joined.select("doc", n.alias("n_dropped"), F.coalesce("is_copy", F.lit(False)).alias("is_copy"), "bad")
    out = counted.withColumn("new", new)
    doc = F.col("doc").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    n_lines = F.size(F.filter(F.split(_text(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")).cast("long")
    return out.select(doc.alias("doc"), n_lines.alias("n_lines"), "n_dropped", "is_copy")
