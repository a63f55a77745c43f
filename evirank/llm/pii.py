"""Information-theoretic sanitisation with DataFrame functions only.

Four patterns find protected values (email, ip, card, phone). Entities are these values and what they belong to: the domain of an
address, the network of an ip, the issuer of a card, the prefix of a phone number. Every word of a text that holds an entity is a term that may
reveal it. All counts are of distinct texts, so copies count once: n(e) with an entity, n(t) with a term, n(e, t) with both. A text is no
proof of what it gives away itself, so a term is judged in each text by the others: of the n(t) - 1 other texts with the term, n(e, t) - 1 hold the entity,
and its disclosure is the lower end of the one-sided confidence interval (Wilson's, 95 %) of that share, the probability of the entity given the term
that the corpus vouches for. Minus its binary logarithm are the bits about the entity that the term leaves open. From GENERALISE on (1 bit open) a term becomes a placeholder wherever it
stands in texts with the entity; from REMOVE on (about a quarter bit) it is cut out of all texts, since it gives the entity away by itself. A word that
met the entity once, or a few times by chance, stays. Every pair that can disclose is judged.

Entities that stand in just the same texts have the same counts with every term and are judged as one, so a text with many values does not
pair each of them with each of its words. A pair can only reach GENERALISE if n(e, t) is at least LEAST, which the interval alone fixes, and n(t) at most a bound
in n(e). So entities and terms of fewer texts with entities than LEAST are left out before anything is paired, and more frequent terms, which disclose no entity of the text,
are left out of the pairs; nothing else is. A list of very many addresses pairs its words with what they belong to, not with each of them. Only words of texts with entities are ever
written; n(t) is one aggregate over the words of all rows, less what copies add. A frequent entity or term is never gathered into one row or one task:
texts stay rows, counts are combined before they are shuffled, and what meets very many rows is sent to them.

Defined results: null text counts as empty and has no spans; repeated rows each get the same spans; spans are in code points,
ends exclusive; a term that overlaps a base span is left to that span; ids may be null or repeat; an empty table gives no rows; extra columns
are dropped by spans() and kept, whatever their names, by sanitised().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.llm.common import few, fresh, joined, key_of, texts_of, written

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE, BLOCK = 0.5, 0.85, 256
#: Square of the normal quantile of a one-sided interval of 95 %, and the fewest joint texts whose lower end reaches GENERALISE if no other text has the term.
Z2 = 1.6449**2
LEAST = math.ceil(GENERALISE * Z2 / (1 - GENERALISE)) + 1
#: A match begins where a run of its first characters begins or where the last match ended, so no run is tried twice.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match holds, to pass over other texts quickly.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_BREAKS = "\n\t\r\x0b\x0c.,;:!?()\"'|"
_SPAN = "array<struct<start: int, kind_no: int, end: int, kind: string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _digit_sum(s: Column) -> Column:
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, x: a + F.when(x == "", 0).otherwise(x.cast("int")))


def _luhn(m: Column) -> Column:
    """Every second digit from the right counts double, less nine where that has two digits."""
    back = F.reverse(_digits(m))
    single, double = F.regexp_replace(back, "(.).?", "$1"), F.regexp_replace(back, ".(.?)", "$1")
    return (_digit_sum(single) + _digit_sum(F.translate(double, "0123456789", "0246813579"))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(12, 19), _luhn(m)).otherwise(False)
    return F.length(_digits(m)).between(9, 15)


def _placed(gaps: Column, matches: Column) -> Column:
    """Start of each match: sums of the lengths before it, by blocks so that many matches stay cheap."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))

    def add(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def build(parts: Column) -> Column:
        own = parts["steps"]
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(own) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(own, 1, (b * BLOCK).cast("int"))))
        return F.transform(
            matches,
            lambda m, i: F.get(blocks, (i / BLOCK).cast("int")) + add(F.slice(own, (i - i % BLOCK + 1).cast("int"), i % BLOCK)) + F.length(F.get(gaps, i)),
        )

    # a one-element array binds the lengths, so that they are worked out once
    return F.get(F.transform(F.array(F.struct(steps.alias("steps"))), build), 0)


def _before(values: Column, fold, both) -> Column:
    """What fold makes of the values before each place, by blocks of about the root of their number; both joins two such results."""

    def build(x: Column) -> Column:
        own, block = x["own"], x["block"]
        whole = F.transform(F.sequence(F.lit(0), ((F.size(own) - 1) / block).cast("int")), lambda b: fold(F.slice(own, 1, b * block)))
        each = lambda s: F.transform(own, lambda _, i: both(F.get(s, (i / block).cast("int")), fold(F.slice(own, i - i % block + 1, i % block))))
        return F.get(F.transform(F.array(whole), each), 0)

    block = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"))
    # one-element arrays bind values and block results, so that they are worked out once
    return F.get(F.transform(F.array(F.struct(values.alias("own"), block.alias("block"))), build), 0)


def _most_before(ends: Column) -> Column:
    return _before(ends, lambda a: F.coalesce(F.array_max(a), F.lit(0)), F.greatest)


def _found(kind: str, text: Column) -> Column:
    pattern, no = _PATTERNS[kind], KINDS.index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if _NEEDS[kind]:
        matches = F.when(F.contains(text, F.lit(_NEEDS[kind])), matches).otherwise(F.array().cast("array<string>"))

    def build(x: Column) -> Column:
        m = x["m"]
        starts = F.arrays_zip(_placed(x["g"], m).alias("s"), m.alias("m"))
        rows = F.transform(starts, lambda r: F.struct(r["s"].cast("int").alias("start"), F.lit(no).alias("kind_no"), (r["s"] + F.length(r["m"])).cast("int").alias("end"), F.lit(kind).alias("kind")))
        return F.filter(F.zip_with(rows, m, lambda r, v: F.when(_valid(kind, v), r)), lambda r: r.isNotNull())

    bound = F.transform(F.array(matches), lambda m: F.when(F.size(m) > 0, F.struct(m.alias("m"), F.split(text, pattern, -1).alias("g"))))
    return F.get(F.transform(bound, lambda x: F.when(x.isNotNull(), build(x)).otherwise(F.array().cast(_SPAN))), 0)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then by kind."""
    return F.sort_array(F.concat(*(_found(k, text) for k in KINDS)))


def _entities(text: Column, s: Column) -> Column:
    """The value of a span and what it belongs to."""
    raw = F.substring(text, s["start"] + 1, s["end"] - s["start"])
    low, digits = F.lower(raw), _digits(raw)
    value = F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), digits).otherwise(low))
    of = (
        F.when(s["kind"] == "email", F.concat(F.lit("domain:"), F.substring_index(low, "@", -1)))
        .when(s["kind"] == "ip", F.concat(F.lit("network:"), F.substring_index(low, ".", 3)))
        .when(s["kind"] == "card", F.concat(F.lit("issuer:"), F.substring(digits, 1, 6)))
        .otherwise(F.concat(F.lit("prefix:"), F.substring(digits, 1, 5)))
    )
    return F.array(F.xxhash64(value), F.xxhash64(of))


def _spaced(text: Column) -> Column:
    """Breaks as spaces, one for one."""
    return F.translate(text, _BREAKS, " " * len(_BREAKS))


def _raw_words(text: Column) -> Column:
    """Words as they stand; breaks are one character each."""
    return F.split(_spaced(text), " ", -1)


def _terms(text: Column) -> Column:
    """Rows of the distinct words in lower case, and of the empty one. Words lower one by one as they do between spaces, so the text is lowered as a whole."""
    return F.explode(F.array_distinct(F.split(F.lower(_spaced(text)), " ", -1)))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, base spans, entities) of each row, without its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    entities = F.array_distinct(F.flatten(F.transform("base", lambda s: _entities(F.col("text"), s))))
    return found.select("doc_id", F.xxhash64("text").alias("text_key"), "base", entities.alias("entities"))


def _disclosure(n_et: Column, n_t: Column) -> Column:
    """The lower end of the interval of (n_et - 1) of (n_t - 1); 0 without other texts."""
    n = (n_t - 1).cast("double")
    share = (n_et - 1) / n
    low = (share + Z2 / (2 * n) - math.sqrt(Z2) * F.sqrt(share * (1 - share) / n + Z2 / (4 * n * n))) / (1 + Z2 / n)
    return F.when(n > 0, low).otherwise(0.0)


def held_entities(scanned: DataFrame) -> DataFrame:
    """(text_key, entity, n_e, most) in storage: one entity for all that stand in the same texts, if these are LEAST at least; most is the largest n(t) at which
    n(e, t) = n(e) can still give GENERALISE, and a little more for rounding: the interval's end lies below the share."""
    holds = scanned.where(F.size("entities") > 0).select("text_key", "entities").dropDuplicates(["text_key"]).select("text_key", F.explode("entities").alias("entity"))
    holds = written(holds, "pii-holds")
    of_entity = holds.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor("text_key").alias("s1"), F.sum(F.pmod(F.xxhash64("text_key"), F.lit(1 << 31))).alias("s2"))
    alike = written(of_entity.where(F.col("n_e") >= LEAST).groupBy("n_e", "s1", "s2").agg(F.min("entity").alias("entity")).select("entity", "n_e"), "pii-entities")
    most = ((F.col("n_e") - 1) / GENERALISE + 1) * (1 + 1e-9)
    return written(joined(holds, alike, ["entity"], "n_e").withColumn("most", most), "pii-held")


def term_counts(documents: DataFrame, scanned: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_t): in how many distinct texts each wanted term (a table in storage) stands. Words are counted over all rows, and what copies of
    a text add is taken off again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = documents.select(_terms(text).alias("term")).join(few(wanted), "term", "left_semi").select("term", F.lit(1).cast("bigint").alias("w"))
    copies = written(scanned.groupBy("text_key").agg(F.count("*").alias("c")).where("c > 1"), "pii-copies")
    again = texts_of(documents, copies, text_col).join(few(copies), "text_key").select((1 - F.col("c")).alias("w"), _terms(F.col("text")).alias("term"))
    return one.unionByName(again.join(few(wanted), "term", "left_semi")).groupBy("term").agg(F.sum("w").alias("n_t"))


def flagged_terms(documents: DataFrame, scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, term, d): each flagged term of each distinct text, with its largest disclosure there."""
    held = held_entities(scanned)
    of_text = written(held.groupBy("text_key").agg(F.max("most").alias("text_most")), "pii-texts")
    words = written(texts_of(documents, of_text, text_col).select("text_key", _terms(F.col("text")).alias("term")).where("term <> ''"), "pii-words")
    inside = written(words.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST), "pii-inside")
    counts = term_counts(documents, scanned, inside.select("term"), text_col).join(inside, "term")
    top = held.agg(F.max("most")).first()[0] or 0.0
    counts = written(counts.where(F.col("n_t") <= top), "pii-counts")
    beside = joined(words, counts, ["term"], "n").join(of_text, "text_key").where(F.col("n_t") <= F.col("text_most")).select("text_key", "term", "n_t")
    pairs = written(beside.join(held, "text_key").where(F.col("n_t") <= F.col("most")).select("text_key", "entity", "term", "n_t"), "pii-pairs")
    judged = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.max("n_t").alias("n_t"))
    judged = judged.withColumn("d", _disclosure(F.col("n_et"), F.col("n_t"))).where(F.col("d") >= GENERALISE)
    judged = written(judged.select("entity", "term", "n_et", "n_t", "d"), "pii-flagged")
    own = joined(pairs.select("text_key", "entity", "term"), judged.select("entity", "term", "n_et", "d"), ["entity", "term"], "n_et").select("text_key", "term", "d")
    # terms that tell by themselves and that also stand in texts without the entity
    alone = written(judged.where((F.col("d") >= REMOVE) & (F.col("n_t") > F.col("n_et"))).groupBy("term").agg(F.max("d").alias("d")), "pii-alone")
    if not alone.isEmpty():
        text = F.coalesce(F.col(text_col), F.lit(""))
        every = documents.select(text.alias("text")).select(F.xxhash64("text").alias("text_key"), _terms(F.col("text")).alias("term"))
        own = own.unionAll(every.join(few(alone), "term").select("text_key", "term", "d"))
    return own.groupBy("text_key", "term").agg(F.max("d").alias("d"))


def term_spans(documents: DataFrame, flagged: DataFrame, scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, terms): the places of the flagged terms (a table in storage) of each distinct text, by start, but for those that meet a base span."""
    keys = written(flagged.select("text_key").distinct(), "pii-marked")
    words = texts_of(documents, keys, text_col).select("text_key", F.posexplode(_raw_words(F.col("text"))).alias("no", "word"))
    before = Window.partitionBy("text_key").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("start", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)).cast("int")).where("word <> ''")
    found = placed.select("text_key", F.lower("word").alias("term"), "start", (F.col("start") + F.length("word")).cast("int").alias("end")).join(flagged, ["text_key", "term"])
    base = scanned.join(few(keys), "text_key", "left_semi").select("text_key", "base").dropDuplicates(["text_key"]).select("text_key", F.explode("base").alias("b"))
    none = F.lit(None).cast("double")
    both = found.select("text_key", "start", "end", "d").unionAll(base.select("text_key", "b.start", "b.end", none.alias("d")))
    order = Window.partitionBy("text_key").orderBy("start", F.col("d").isNotNull())
    reach = F.max(F.when(F.col("d").isNull(), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("d").isNull(), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = both.withColumn("reach", F.coalesce(reach, F.lit(0))).withColumn("ahead", ahead).where("d is not null and reach <= start and (ahead is null or ahead >= end)")
    kind = F.when(F.col("d") >= REMOVE, "remove").otherwise("term")
    return clear.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind_no"), "end", kind.alias("kind")))).alias("terms"))


def spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, base, spans): base spans, and these with the disclosing terms, of each row."""
    scanned = written(scan(documents, id_col, text_col), "pii-scan")
    added = written(term_spans(documents, written(flagged_terms(documents, scanned, text_col), "pii-terms"), scanned, text_col), "pii-places")
    keys = few(added.select("text_key"))
    both = scanned.join(keys, "text_key", "left_semi").join(added, "text_key").select("doc_id", "text_key", "base", F.sort_array(F.concat("base", "terms")).alias("spans"))
    return both.unionAll(scanned.join(keys, "text_key", "left_anti").select("doc_id", "text_key", "base", F.col("base").alias("spans")))


def said(spans_: Column) -> Column:
    return F.concat_ws(",", F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digests(documents: DataFrame) -> DataFrame:
    found = spans(documents)
    count = [(F.size("base") - F.size(F.array_remove(F.transform("base", lambda s: s["kind"]), k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redacted(text: Column, spans_: Column) -> Column:
    """The text with base spans and generalised terms as placeholders and removed terms cut out; spans may overlap and lie inside one another."""

    def piece(x: Column) -> Column:
        s, before = x["s"], x["before"]
        mark = F.when(s["kind"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        kept = F.substring(text, before + 1, F.greatest(F.lit(0), s["start"] - before))
        return F.concat(kept, F.when(s["end"] > before, mark).otherwise(""))

    ends = F.transform(spans_, lambda s: s["end"])
    placed = F.arrays_zip(spans_.alias("s"), _most_before(ends).alias("before"))  # the furthest end of all spans before each
    rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
    return F.when(F.size(spans_) == 0, text).otherwise(F.concat(F.concat_ws("", F.transform(placed, piece)), rest))


def sanitised(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with redacted texts; all other columns and null texts stay."""
    key, own, n = fresh(documents, "text_key"), fresh(documents, "spans"), fresh(documents, "n")
    found = spans(documents.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    found = written(found.where(F.size("spans") > 0).groupBy("text_key").agg(F.first("spans").alias("spans"), F.count("*").alias("n")), "pii-found")
    keyed, keys = documents.withColumn(key, key_of(F.col(text_col))), few(found.select(F.col("text_key").alias(key)))
    marked = joined(keyed.join(keys, key, "left_semi"), found.select(F.col("text_key").alias(key), F.col("spans").alias(own), F.col("n").alias(n)), [key], n)
    changed = marked.withColumn(text_col, redacted(F.col(text_col), F.col(own)))
    return changed.select(*documents.columns).unionAll(keyed.join(keys, key, "left_anti").select(*documents.columns))
