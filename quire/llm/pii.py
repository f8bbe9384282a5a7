"""Personal data: fixed forms, and terms that reveal them, in DataFrame operations only.

The fixed forms (e-mail, IP address, card, phone) are the protected entities: each distinct value is one, and so is each form as such. Terms are the words of
the whole text that lie in no fixed form. Over the corpus, with probabilities as shares of documents,

    information of an entity         IC(c) = -log2 p(c)
    what a term tells of it          PMI(c; t) = log2 (p(c, t) / (p(c) p(t)))
    disclosure                       PMI / IC, which is 1 where the term occurs only together with the entity

A term whose disclosure for any entity reaches ``GENERALISE`` becomes a span to be generalised, from ``REMOVE`` on one to be removed: at every place where it
stands, in every document.
All counts are of independent documents: documents count once for each least shingle hash, so copies change no count, and near copies
of one text count as often as their least shingles differ. A pair is evidence only if it is met in ``SUPPORT`` of them, and so often that chance hardly
explains it: were term and entity independent, the probability of as many meetings (by Chernoff's bound), times the number of pairs that are compared,
would stay below ``CHANCE``. So the more pairs a corpus has, the more support a pair needs.

Of the fixed forms only e-mail addresses hold letters, so terms are the words of what e-mail addresses leave.

Patterns are written so that Java's engine runs in linear time and without recursion on very long texts; they match what the plain
forms ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, ``[0-9]([\\x20-]?[0-9])+`` and
``\\+[0-9][\\x20().0-9-]+[0-9]`` match: a run that fails from its first character fails from every other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import bound
from quire.llm.common import bit_map, fresh, keep

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "general", "removed")
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
#: Terms that chance alone may bring in, over all pairs.
CHANCE = 0.01
#: The terms' spans.
ADDED = "uid long, doc_id long, start int, order int, end int, kind string, value string"
#: Matches that one fold gathers.
BLOCK = 128
#: A term: a word of at least four letters.
_TERM = r"\p{L}{4,}"
#: Bits of the map of terms whose document frequency is wanted; a full map only lets more words through to the count.
MAP_BITS = 1 << 19


def spans(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """All matches (that are ``wanted``) as ``array<struct<start, end, value>>`` in code points: lengths of matches and of what lies between them add up.

    A fold copies what it has gathered at each step, so it goes over ``BLOCK`` matches only; a second one adds up the lengths of the blocks.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["between"])
        end = start + F.length(part["found"])
        out = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), part["found"].alias("value"))))
        more = F.struct(end.alias("at"), (F.when(wanted(part["found"]), out).otherwise(acc["out"]) if wanted else out).alias("out"))
        return F.when(part["found"].isNull(), acc).otherwise(more)  # the last part is followed by no match

    def block(own: Column) -> Column:
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def placed(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = lambda b, by: F.transform(b["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))
        return bound(begins, lambda at: F.flatten(F.transform(blocks, lambda b, i: moved(b, F.get(at, i)))))

    def blocks(all_: Column) -> Column:
        first = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return bound(F.transform(first, lambda i: block(F.slice(all_, i * BLOCK + 1, BLOCK))), placed)

    return bound(parts, lambda all_: F.when(F.size(all_) <= BLOCK, block(all_)["out"]).otherwise(blocks(all_)))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _checked(found: Column, kind: str, order: int) -> Column:
    good = F.filter(found, lambda s: _valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """``array<struct<start, order, end, kind, value>>`` of the fixed forms, sorted by start, then kind as listed."""
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": F.contains(text, F.lit("+"))}
    each = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        made = _checked(spans(text, pattern), kind, order)
        each.append(F.when(may[kind], made).otherwise(F.expr("cast(array() as array<struct<start: int, order: int, end: int, kind: string, value: string>>)")))
    return F.array_sort(F.concat(*each))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def without_addresses(text: Column) -> Column:
    """``text`` with a space for every character of e-mail addresses, so that what is left keeps its place."""
    pattern = PATTERNS["email"]
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    blank = F.transform(parts, lambda p: F.concat(p["between"], F.coalesce(F.repeat(F.lit(" "), F.length(p["found"])), F.lit(""))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(blank, "")).otherwise(text)


def _words(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), lambda t: F.lower(t))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Base spans ``uid, doc_id, base`` of every row, and the terms' spans ``uid, doc_id, start, order, end, kind, value`` that the method adds.

    ``uid`` is a hash of the text: rows that share id and text share their terms' spans.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))

    def least_shingle(w: Column) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    # the words are bound to a variable: an expression in a lambda would be evaluated for each of its elements
    shingle = F.get(F.transform(F.array(F.split("text", " ")), least_shingle), F.lit(0))
    uid = F.xxhash64("text").alias("uid")
    rows = source.select("doc_id", "text", uid, F.explode(F.array(base_spans(F.col("text")))).alias("base"))  # a generator is evaluated once
    has = F.size("base") > 0
    values = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    forms = F.array_distinct(F.transform("base", lambda s: s["kind"]))
    terms = F.array_distinct(_words(without_addresses(F.col("text"))))
    rows = rows.select("doc_id", "uid", "base", F.when(has, forms).alias("forms"), F.when(has, values).alias("values"), F.when(has, terms).alias("terms"), shingle.alias("print"))
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "pii-base")

    prints = keep(rows.groupBy("print").agg(F.count("*").alias("n_rows")), "pii-prints")
    total = float(max(prints.count(), 1))
    # only prints that may be shared are counted apart, so that all else is summed before it moves
    shared = bit_map(prints.filter("n_rows > 1"), "print", MAP_BITS)

    def independent(met: DataFrame, name: str, *keys: str) -> DataFrame:
        """How many independent documents each key is met in; ``met`` has each key of a document once, and its print (or null, if it is alone)."""
        apart = met.groupBy(*keys, "copy").agg(F.count("*").alias("n"))
        return apart.groupBy(*keys).agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(F.lit(1).cast("long"))).alias(name))

    copy = F.when(shared(F.col("print")), F.col("print")).alias("copy")
    held = rows.filter("values is not null").select("row", copy, "forms", "values", "terms")
    # terms and entities that are met in fewer independent documents can't have evidence; tables of these cut the plan, so that frequent ones can be split in joins
    enough = lambda n: F.col(n) >= SUPPORT
    beside = keep(independent(held.select("copy", F.explode("terms").alias("term")), "n_beside", "term").filter(enough("n_beside")), "pii-beside")
    entities = keep(independent(held.select("copy", F.explode(F.concat("forms", "values")).alias("entity")), "n_entity", "entity").filter(enough("n_entity")), "pii-entities")
    n_pairs = beside.count() * entities.count()
    ic = -F.log2(F.col("n_entity") / F.lit(total))

    def disclosure(n_term: Column) -> Column:
        return F.when(ic > 0, F.log2(F.col("n_joint") * F.lit(total) / (F.col("n_entity") * n_term)) / ic).otherwise(0.0)

    def telling(n_term: Column) -> Column:
        """Whether a term of that frequency (a smaller one only makes it likelier) tells enough, and more than by chance."""
        k, by_chance = F.col("n_joint"), F.col("n_entity") * n_term / F.lit(total)
        rare = (k > by_chance) & (k * F.ln(k / by_chance) - k + by_chance >= math.log(max(n_pairs, 1) / CHANCE))
        return (disclosure(n_term) >= GENERALISE) & rare

    # the few forms go with all terms of a document; values only with those that are rare enough to tell of one: n_term <= n_entity (total / n_entity) ** (1 - GENERALISE)
    supported = bit_map(beside, "term", MAP_BITS)
    by_form = held.select("copy", F.explode("forms").alias("entity"), supported.among("terms").alias("terms")).select("copy", "entity", F.explode("terms").alias("term"))
    known = entities.filter(F.contains("entity", F.lit(":")))
    most = known.agg(F.max(F.col("n_entity") * F.pow(F.lit(total) / F.col("n_entity"), 1 - GENERALISE))).first()[0] or 0.0
    rare = bit_map(beside.filter(F.col("n_beside") <= most), "term", MAP_BITS)
    met = held.select("row", F.explode("values").alias("entity")).join(known, "entity").groupBy("row").agg(F.collect_list("entity").alias("met"))
    by_value = held.select("row", "copy", rare.among("terms").alias("terms")).filter(F.size("terms") > 0).join(met, "row")
    by_value = by_value.select("copy", "met", F.explode("terms").alias("term")).select("copy", F.explode("met").alias("entity"), "term")
    joint = keep(independent(by_form.unionByName(by_value), "n_joint", "entity", "term").filter(enough("n_joint")), "pii-pairs")
    # a term is at least as frequent as beside personal data of any kind, which bounds what it can tell
    joint = keep(joint.join(entities, "entity").join(beside, "term").filter(telling(F.col("n_beside"))), "pii-joint")
    if joint.isEmpty():
        return rows.select("uid", "doc_id", "base"), spark.createDataFrame([], ADDED)

    # document frequencies of the terms over the whole corpus: a map of fixed size thins the words before they are counted. First in all documents whose print is their
    # own, where counts are summed before they move; what these leave of the terms is then counted in the others, print by print
    bare = source.select("doc_id", uid, F.col("text").alias("whole"), F.explode(F.array(without_addresses(F.col("text")))).alias("text"))
    alike = bit_map(rows.filter(shared(F.col("print"))), "uid", MAP_BITS)
    may_be = bit_map(joint.select("term").distinct(), "term", MAP_BITS)
    alone = bare.filter(~alike(F.col("uid"))).select(F.explode(F.array_distinct(may_be.among(_words("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_alone"))
    joint = joint.join(alone, "term", "left").withColumn("n_alone", F.coalesce("n_alone", F.lit(0).cast("long")))
    joint = keep(joint.filter(telling(F.greatest("n_beside", "n_alone"))), "pii-alone")
    left_over = bit_map(joint.select("term").distinct(), "term", MAP_BITS)
    once = bare.filter(alike(F.col("uid"))).select(bound(F.split("whole", " "), least_shingle).alias("copy"), F.explode(F.array(F.array_distinct(left_over.among(_words("text"))))).alias("terms"))
    others = independent(once.select("copy", F.explode("terms").alias("term")), "n_others", "term")
    n_term = F.col("n_alone") + F.coalesce("n_others", F.lit(0).cast("long"))
    told = joint.join(others, "term", "left").withColumn("n_term", n_term).withColumn("disclosure", disclosure(F.col("n_term"))).filter(telling(F.col("n_term")))
    kind = F.when(F.max("disclosure") >= REMOVE, "removed").otherwise("general")
    told = keep(told.groupBy(F.col("term").alias("value")).agg(kind.alias("kind")), "pii-told")
    if told.isEmpty():
        return rows.select("uid", "doc_id", "base"), spark.createDataFrame([], ADDED)

    # every occurrence of these terms, in all documents
    there = bit_map(told, "value", MAP_BITS)
    places = bare.select("doc_id", "uid", F.explode(there.within(lambda test: spans(F.col("text"), _TERM, lambda t: test(F.lower(t))))).alias("t"))
    places = places.select("doc_id", "uid", "t.start", "t.end", F.lower("t.value").alias("value")).distinct()
    added = places.join(told, "value").select("uid", "doc_id", "start", F.when(F.col("kind") == "general", 4).otherwise(5).alias("order"), "end", "kind", "value")
    return rows.select("uid", "doc_id", "base"), keep(added, "pii-added")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_terms, base_sha256, spans, found`` of every row.

    ``spans`` lists kind:start:end by start, then kind; ``found`` holds the same with the matched values. A null text is an empty one, without
    spans. Repeated rows each give a row; as evidence they count once. An empty table gives no rows. Other columns are not read.
    """
    base, added = find(docs, id_col, text_col)
    more = added.groupBy("uid", "doc_id").agg(F.collect_list(F.struct("start", "order", "end", "kind", "value")).alias("more")).select(F.col("uid").alias("of"), F.col("doc_id").alias("id"), "more")
    none = F.expr("cast(array() as array<struct<start: int, order: int, end: int, kind: string, value: string>>)")
    rows = base.join(more, (F.col("uid") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").withColumn("found", F.array_sort(F.concat("base", F.coalesce("more", none))))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, PATTERNS), F.size(F.coalesce("more", none)).cast("long").alias("n_terms"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "found")


def rewritten(text: Column, found: Column) -> Column:
    """``text`` with spans replaced by their kind in brackets; removed terms go. Of overlapping spans the first counts."""

    def step(acc: Column, s: Column) -> Column:
        word = F.when(s["kind"] == "removed", "").when(s["kind"] == "general", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        out = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), word)
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), out.alias("out"))).otherwise(acc)

    done = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(found) > 0, F.concat(done["out"], text.substr(done["at"] + 1, F.length(text)))).otherwise(text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with personal data and revealing terms replaced in the text (null stays null).

    Terms' spans are met by id and a hash of the text; the planner broadcasts them where their files are small.
    """
    _, added = find(docs, id_col, text_col)
    of, of_id, more_, found_ = (fresh(x, docs) for x in ("span_text", "span_id", "more_spans", "found_spans"))
    more = added.groupBy(F.col("uid").alias(of), F.col("doc_id").alias(of_id)).agg(F.collect_list(F.struct("start", "order", "end", "kind", "value")).alias(more_))
    none = F.expr("cast(array() as array<struct<start: int, order: int, end: int, kind: string, value: string>>)")
    text = F.col(text_col)
    rows = docs.join(more, (F.xxhash64(text) == F.col(of)) & F.col(id_col).cast("long").eqNullSafe(F.col(of_id)), "left")
    found = F.array_sort(F.concat(base_spans(text), F.coalesce(F.col(more_), none)))
    rows = rows.select("*", F.explode(F.array(F.when(text.isNotNull(), found))).alias(found_))  # evaluated once
    return rows.withColumn(text_col, F.when(text.isNotNull(), rewritten(text, F.col(found_)))).select(*docs.columns)
