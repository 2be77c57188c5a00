"""Personal data: patterns, and terms that give the found values away.

Email and IP addresses, card and phone numbers are found by pattern. Then the words
of the documents with each found value are looked at over the whole corpus. Of the k
different texts that hold a term, b may hold the value too; then

    -log2((b + a) / (k + a + PRIOR))

bits are still missing to tell from the term that the text is about the value. ``PRIOR`` is
a text assumed to hold the term without the value, so little evidence leaves more bits
missing; a = ``NAMED`` texts more speak for a term that is spelled in the value, or that is
written as a name beside it: with a capital inside a sentence. Terms that leave at most
``GENERALISE`` bits are generalised wherever they occur, those that leave at most ``REMOVE``
bits are removed. Only texts with the term or the value count, so other documents change
no verdict, and copies of a text are no further evidence. A rare word that stands once
beside a value stays, unless it is written as a name.

A term may be any run of letters and digits that stands outside the found values at least
once. Terms are counted first; those of one text need no partner, and pairs are only formed
of terms that could reach the threshold and values of two or more texts.

Everything is made of Spark expressions.

Defined results: a null text is empty and has no spans; sanitising leaves it null.
Repeated rows are judged row by row. Other columns are carried unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import quoted, whole_row
from tidewatch.session import cut

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PRIOR = 1.0
NAMED = 2.0
#: Bits missing at most.
GENERALISE = 0.5
REMOVE = 0.15
#: Matches of a text that are walked together: work grows with their number, not its square.
WALKED = 256
#: Disclosing terms, or documents with them, that are still sent to every task; the
#: bytes of both are checked. Of more terms, so many are sent as their hashes.
BROADCAST_TERMS = 20_000
BROADCAST_BYTES = 8 << 20
BROADCAST_HASHES = 2_000_000

# A match that starts inside a run could only do so where the one before it ended;
# looking behind keeps long runs from being read again from each of their characters.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried at all.
_HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LETTER = r"[\p{L}\p{N}]"
#: A term that begins with a capital and goes on in small letters or digits, behind something
#: other than the end of a sentence or a line.
_NAME = rf"(?<=[^\s.!?:;][ \t,]{{1,2}})(\p{{Lu}}[\p{{Ll}}\p{{N}}]+)(?!{_LETTER})"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPAN = "struct<start:bigint,end:bigint,value:string>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    match kind:
        case "ip":
            return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
        case "card":
            digits = _digits(match)
            return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
        case "phone":
            return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _chunks(values: Column) -> Column:
    n = F.ceil(F.size(values) / WALKED).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.slice(values, c * WALKED + 1, WALKED)))


def _placed(text: Column, pattern: Column, found: Column) -> Column:
    """Spans of the matches ``found``: what lies between them has known lengths."""
    pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("value"))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["gap"])
        end = begin + F.length(piece["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), piece["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def chunk(state: Column, part: Column) -> Column:
        walked = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("spans")), step)
        return F.struct(walked["at"].alias("at"), F.concat(state["spans"], F.array(walked["spans"])).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("spans"))
    return F.coalesce(F.aggregate(_chunks(pieces), start, chunk, lambda state: F.flatten(state["spans"])), none)


def _only_valid(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["value"]))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add a column of base spans (start, end, value) per kind; offsets count code points."""
    none = F.array().cast("array<string>")
    whole = F.coalesce(F.col(text), F.lit(""))
    found = {
        f"__{kind}": F.when(F.contains(whole, F.lit(_HINTS[kind])), F.regexp_extract_all(whole, F.lit(_PATTERNS[kind]), 0)).otherwise(none)
        for kind in KINDS
    }
    placed = {
        kind: F.when(F.size(f"__{kind}") > 0, _placed(whole, F.lit(_PATTERNS[kind]), F.col(f"__{kind}"))).otherwise(
            F.array().cast(f"array<{_SPAN}>")
        )
        for kind in KINDS
    }
    valid = {kind: _only_valid(kind) for kind in KINDS}
    return docs.withColumns(found).withColumns(placed).withColumns(valid).drop(*found)


def _terms(text: Column) -> Column:
    """Runs of letters and digits, A-Z lower-cased."""
    plain = F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda t: t != "")


def _entity(kind: str, value: Column) -> Column:
    plain = _digits(value) if kind in ("card", "phone") else F.translate(value, _UPPER, _LOWER)
    return F.concat(F.lit(f"{kind}:"), plain)


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda s: _entity(kind, s["value"]))


def _standing(place: str) -> Column:
    return F.transform(
        place,
        lambda t: F.struct(t.alias("term"), F.lit(place == "outside").alias("out"), F.array_contains("names", t).alias("named")),
    )


def base(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, spans per kind; entities: the values; and, where there
    are any, the terms of the text: those also outside of the values, and the others;
    and those of them that are spelled in a value or written as names."""
    spans = with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    entities = F.flatten(F.array(*map(_entities, KINDS)))
    blanks = [F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("put"))) for kind in KINDS]
    bare = [F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(kind) for kind in KINDS]
    has_any = sum((F.size(kind) for kind in KINDS), F.lit(0)) > 0
    none = F.array().cast("array<string>")
    rest = _replaced(F.col("text"), F.array_sort(F.flatten(F.array(*blanks))))
    spelled = F.flatten(F.transform(F.flatten(F.array(*[F.transform(kind, lambda s: s["value"]) for kind in KINDS])), _terms))
    capital = F.transform(F.regexp_extract_all(F.col("rest"), F.lit(_NAME), F.lit(1)), lambda t: F.translate(t, _UPPER, _LOWER))
    rows = (
        spans.withColumn("rest", F.when(has_any, rest))
        .select(
            "doc_id", F.xxhash64("text").alias("hash"), *bare, F.array_distinct(entities).alias("entities"),
            F.when(has_any, _terms(F.col("text"))).otherwise(none).alias("all"),
            F.when(has_any, _terms(F.col("rest"))).otherwise(none).alias("free"),
            F.when(has_any, F.array_distinct(F.concat(spelled, capital))).otherwise(none).alias("names"),
        )
    )
    return rows.withColumns({"outside": F.array_intersect("all", "free"), "inside": F.array_except("all", "free")}).drop("all", "free")


def _missing_bits(both: Column, texts: Column, named: Column) -> Column:
    more = F.when(named, F.lit(NAMED)).otherwise(F.lit(0.0))
    return -F.log2((both + more) / (texts + more + PRIOR))


def standing_terms(found: DataFrame, n_terms: DataFrame) -> DataFrame:
    """(term, named, n_beside, texts): terms that stand outside a value in a document with
    one; the different texts of those documents, and of all documents that hold it."""
    counted = _beside(found).groupBy("term").agg(
        F.count("*").alias("n_docs"), F.count_distinct("hash").alias("n_beside"), F.max("out").alias("out"), F.max("named").alias("named")
    )
    # documents are counted in texts as those beside a value are
    texts = F.col("n_term") * F.col("n_beside") / F.col("n_docs")
    return counted.filter("out").join(n_terms, "term").select("term", "named", "n_beside", texts.alias("texts"))


def _beside(found: DataFrame) -> DataFrame:
    """(row, hash, term, out, named): the terms of documents with a value."""
    with_any = found.filter(F.size("entities") > 0).withColumn("row", F.monotonically_increasing_id())
    terms = with_any.select("row", "hash", F.explode(F.concat(_standing("outside"), _standing("inside"))).alias("t"))
    return terms.select("row", "hash", "t.*")


def candidates(found: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, entity, n_both): different texts with both a term and a value. With
    ``terms`` only those, and only values of two or more texts."""
    with_any = found.filter(F.size("entities") > 0).withColumn("row", F.monotonically_increasing_id())
    values = with_any.select("row", "hash", F.explode("entities").alias("entity"))
    standing = _beside(found)
    if terms is not None:
        several = values.groupBy("entity").agg(F.count_distinct("hash").alias("n")).filter("n > 1").select("entity")
        values = values.join(several, "entity")
        standing = standing.join(terms.select("term"), "term")
    lists = values.groupBy("row").agg(F.collect_set("entity").alias("entities"))
    both = standing.join(lists, "row").select("term", "hash", "out", F.explode("entities").alias("entity"))
    counted = both.groupBy("term", "entity").agg(F.count_distinct("hash").alias("n_both"), F.max("out").alias("out"))
    return counted.filter("out").drop("out")


def _all_terms(docs: DataFrame, *more: Column) -> DataFrame:
    whole = F.coalesce("text", F.lit(""))
    return docs.select(*more, F.explode(F.array_distinct(_terms(whole))).alias("term"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n_term): in how many documents each term of the corpus occurs, added
    up in each task before the shuffle."""
    return _all_terms(docs).groupBy("term").agg(F.count("*").alias("n_term"))


def occurrences(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """(doc_id, hash, spans) of the flagged terms in all documents."""
    whole = F.coalesce("text", F.lit(""))
    n_terms, n_bytes = flagged.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    # the words travel without their text
    words = _all_terms(docs, F.col("doc_id").alias("id"), F.xxhash64(whole).alias("of"))
    small = n_terms <= BROADCAST_TERMS and n_bytes <= BROADCAST_BYTES
    if not small and n_terms <= BROADCAST_HASHES:
        hashes = flagged.select(F.xxhash64("term").alias("of_term")).distinct()
        words = words.join(F.broadcast(hashes), F.xxhash64("term") == F.col("of_term"), "left_semi")
    words = words.join(F.broadcast(flagged) if small else flagged, "term")
    of_text = cut(words.groupBy("id", "of").agg(F.collect_set(F.struct("term", "removed")).alias("terms")))
    texts = docs.select("doc_id", whole.alias("text"), F.xxhash64(whole).alias("hash"))
    if of_text.count() <= BROADCAST_HASHES:
        texts = texts.join(F.broadcast(of_text.select("of").distinct()), F.col("hash") == F.col("of"), "left_semi")
    with_terms = texts.dropDuplicates(["doc_id", "hash"]).join(of_text, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of")))
    # terms are whole runs of letters and digits, so at most one of them fits anywhere
    one_of = F.array_join(F.transform("terms", lambda t: t["term"]), "|")
    pattern = F.concat(F.lit(f"(?<!{_LETTER})(?:"), one_of, F.lit(f")(?!{_LETTER})"))
    found = with_terms.select("doc_id", "hash", F.map_from_entries("terms").alias("removed"), F.translate("text", _UPPER, _LOWER).alias("lower"), pattern.alias("pattern"))
    placed = _placed(F.col("lower"), F.col("pattern"), F.regexp_extract_all("lower", F.col("pattern"), F.lit(0)))
    spans = F.transform(
        placed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at("removed", s["value"]).alias("removed"))
    )
    return found.select("doc_id", "hash", F.array_sort(spans).alias("spans"))


def flagged_terms(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame | None:
    """(term, removed) of the terms that leave few enough bits missing; None if none can."""
    if found.filter(F.size("entities") > 0).isEmpty():
        return None
    # if all texts of the term that have a value had the same
    least = _missing_bits(F.col("n_beside"), F.col("texts"), F.col("named"))
    able = cut(standing_terms(found, term_counts(docs)).filter(least <= generalise))
    alone, shared = able.filter("n_beside = 1"), able.filter("n_beside > 1")
    most = candidates(found, shared).groupBy("term").agg(F.max("n_both").alias("n_both"))
    # a term of one text stands beside each of its values
    judged = alone.withColumn("n_both", F.lit(1).cast("bigint")).unionByName(shared.join(most, "term").select(*alone.columns, "n_both"))
    bits = _missing_bits(F.col("n_both"), F.col("texts"), F.col("named"))
    return judged.filter(bits <= generalise).select("term", (bits <= remove).alias("removed"))


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """(doc_id, hash, spans) of the disclosing terms, where a document has any;
    ``spans`` are (start, end, removed). None if there is no such term."""
    flagged = flagged_terms(docs, found)
    if flagged is None:
        return None
    flagged = cut(flagged)
    return None if flagged.isEmpty() else occurrences(docs, flagged)


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _with_terms(rows: DataFrame, terms: DataFrame | None, small: bool = False) -> DataFrame:
    """Add the term spans of each row's document, none if it has no such terms."""
    kind = "array<struct<start:bigint,end:bigint,removed:boolean>>"
    if terms is None:
        return rows.withColumn("terms", F.array().cast(kind))
    side = terms.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__of"), F.col("spans").alias("terms"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__of"))
    joined = rows.join(F.broadcast(side) if small else side, same, "left").drop("__id", "__of")
    return joined.withColumn("terms", F.coalesce("terms", F.array().cast(kind)))


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, spans per kind, base (text of the base spans), terms
    (spans of disclosing terms) and spans (text of all spans)."""
    found = cut(base(docs))
    rows = _with_terms(found, disclosing(docs, found))
    text = F.concat(*[_joined(kind, F.col(kind)) for kind in KINDS])
    return rows.select(
        "doc_id", *KINDS, "terms", F.array_join(text, ",").alias("base"), F.array_join(F.concat(text, _joined(TERM, F.col("terms"))), ",").alias("spans")
    )


def _replaced(text: Column, spans: Column) -> Column:
    """The text with sorted ``spans`` (start, end, put) replaced; where spans
    overlap, the first one's replacement stands for all they cover."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(state: Column, span: Column) -> Column:
        free = span["start"] >= state["at"]
        gap = F.substr(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(free, F.concat(state["out"], F.array(gap, span["put"]))).otherwise(state["out"]).alias("out"),
        )

    def chunk(state: Column, part: Column) -> Column:
        walked = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return F.struct(walked["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(walked["out"], ""))).alias("out"))

    def finish(state: Column) -> Column:
        rest = F.substr(text, (state["at"] + 1).cast("int"))
        return F.array_join(F.concat(state["out"], F.array(rest)), "")

    return F.when(F.size(spans) > 0, F.aggregate(_chunks(spans), start, chunk, finish)).otherwise(text)


def _put(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("put")))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans replaced by their kind in brackets and disclosing
    terms replaced by ``[TERM]`` or removed; ``n_chars``, if there is such a
    column, is counted anew where the text changed."""
    found = cut(base(docs))
    terms = disclosing(docs, found)
    packed = docs.select(whole_row(docs).alias("doc"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")
    small = False
    if terms is not None:
        terms = cut(terms)
        n_bytes = terms.agg(F.coalesce(F.sum(40 + 24 * F.size("spans")), F.lit(0))).first()[0]
        small = n_bytes <= BROADCAST_BYTES
    rows = _with_terms(packed, terms, small)
    puts = map(_put, KINDS)
    of_terms = F.transform(
        "terms",
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("put")),
    )
    spanned = with_spans(rows).withColumn("__spans", F.array_sort(F.flatten(F.array(*puts, of_terms))))
    new = F.when(F.col("text").isNotNull(), _replaced(F.col("text"), F.col("__spans")))
    spanned = spanned.withColumn("__new", new)
    out = []
    for name in docs.columns:
        old = F.col(f"doc.{quoted(name)}")
        if name == "text":
            old = F.col("__new")
        elif name == "n_chars":
            old = F.when(F.size("__spans") > 0, F.length("__new").cast(docs.schema[name].dataType)).otherwise(old)
        out.append(old.alias(name))
    return spanned.select(*out)
