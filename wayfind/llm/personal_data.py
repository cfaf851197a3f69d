"""Personal data by weak supervision (DataFrame functions only).

Base spans come from four strict patterns.  Beyond them stand candidates: spelled-out addresses, phone numbers without
country code, and card-like numbers that fail the check digit.  Three labelers vote for or against every candidate or
abstain: the pattern with its validity checks, a gazetteer (top-level domains, dialling codes, issuer prefixes, routable
networks) and the words around it.  Expectation-maximisation estimates prior and reliabilities per kind from the counts of all
vote patterns, which gives every pattern a probability; with these as soft labels a naive Bayes classifier over votes and
shape is trained on the counts of all candidates, and it decides which candidates are added.  Base spans always stay.

Everything about one text is computed inside its row: positions are running sums over the lengths of the pieces between
matches, taken in blocks, so that a text with very many matches stays linear.  The tables of counts are bounded by the number
of votes, kinds and buckets.

Patterns match from left to right without overlaps per kind; quantifiers are possessive and begin at the start of a run, so
that long runs cost linear time and no stack.  Null text has no spans; an empty table trains nothing; repeated rows are treated
each by itself; further columns are kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import written

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{]at[)\]}] ?[A-Za-z0-9-]++(?: ?(?:[(\[{]dot[)\]}]|\.) ?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9A-Za-z+().-])(?<![+0-9().-] )\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"

TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "it", "nl", "uk", "eu", "ch", "at", "us")
DIALLING = r"^\+?(?:1|33|34|39|41|43|44|49)[^0-9]|^\(?[2-9][0-9]{2}"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
NEAR = {
    "email": r"(?i)mail|contact|write to|correo|kontakt|courriel",
    "ip": r"(?i)\bip\b|server|host|address|adres|from",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"(?i)phone|call|tel\b|tel[.:]|mobile|fax|telefon|número",
}
AGAINST = r"(?i)(?:token|key|hash|id|serial|sha|uuid|0x|[=#\"'$])\s*\S*$|[0-9A-Za-z]$"
ROUNDS = 12
SURE = 0.9
BLOCK = 64


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of longs: sums of whole blocks first, then within each block."""

    def inside(bound: Column) -> Column:
        numbers, bases = bound["values"], bound["bases"]

        def at(_: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            part = F.slice(numbers, block * BLOCK + 1, F.pmod(i, F.lit(BLOCK)) + 1)
            return F.get(bases, block) + F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.transform(numbers, at)

    def bases(numbers: Column) -> Column:
        last = F.floor((F.size(numbers) - 1) / BLOCK).cast("int")
        totals = F.transform(
            F.sequence(F.lit(0), last),
            lambda b: F.aggregate(F.slice(numbers, b * BLOCK + 1, BLOCK), F.lit(0).cast("long"), lambda a, x: a + x),
        )
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(totals, zero, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    summed = bind(values, lambda n: bind(F.struct(n.alias("values"), bases(n).alias("bases")), inside))
    return F.when(F.size(values) > 0, summed).otherwise(F.array().cast("array<long>"))


def found(text: Column, pattern: str, only_if: Column) -> Column:
    """array<struct<start, end, match, before, after>> of the leftmost non-overlapping matches, in code points."""
    pieces = F.transform(
        F.split(text, pattern, -1),
        lambda p: F.struct(F.length(p).cast("long").alias("n"), F.substring(p, -24, 24).alias("tail"), F.substring(p, 1, 8).alias("head")),
    )

    def place(bound: Column) -> Column:
        matches, parts = bound["m"], bound["p"]
        steps = F.transform(matches, lambda m, i: F.length(m) + F.get(parts, i)["n"])
        ends = running_sums(steps)
        return F.zip_with(
            F.arrays_zip(matches.alias("m"), F.slice(parts, 1, F.size(matches)).alias("p"), F.slice(parts, 2, F.size(matches)).alias("q")), ends,
            lambda x, end: F.struct(
                (end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("match"),
                x["p"]["tail"].alias("before"), x["q"]["head"].alias("after"),
            ),
        )

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
    placed = bind(F.struct(matches.alias("m"), pieces.alias("p")), lambda b: F.when(F.size(b["m"]) > 0, place(b)).otherwise(none))
    return F.when(only_if, placed).otherwise(none)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the check of payment cards."""

    def total(rev: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = F.substring(rev, i, F.lit(1)).cast("int")
            twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return acc + F.when(F.pmod(i, F.lit(2)) == 0, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), add)

    return F.pmod(bind(F.reverse(number), total), F.lit(10)) == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _rows(spans: Column, kind: str, base: Callable[[Column], Column], possible: Callable[[Column], Column], listed: Callable[[Column], Column]) -> Column:
    """Spans of one kind with their votes and shape; ``possible`` are kept as candidates where ``base`` does not hold."""

    def judge(x: Column) -> Column:
        def voted(valid: Column) -> Column:
            m, before = x["match"], x["before"]
            near, against = before.rlike(NEAR[kind]), before.rlike(AGAINST)
            return F.struct(
                x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), valid.alias("base"),
                _vote(valid, ~possible(m)).alias("v_pattern"), _vote(listed(m), ~listed(m)).alias("v_list"), _vote(near, against).alias("v_words"),
                F.least(F.length(digits(m)), F.lit(20)).alias("f_digits"),
                F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(6)).alias("f_signs"),
                F.when(before == "", 0).when(before.rlike(r"\s$"), 1).when(before.rlike("[0-9A-Za-z]$"), 2).otherwise(3).alias("f_left"),
                F.when(x["after"] == "", 0).when(x["after"].rlike(r"^\s"), 1).when(x["after"].rlike("^[0-9A-Za-z]"), 2).otherwise(3).alias("f_right"),
            )

        return bind(base(x["match"]), voted)

    return F.transform(F.filter(spans, lambda x: base(x["match"]) | possible(x["match"])), judge)


def _between(match: Column, low: int, high: int) -> Column:
    n = F.length(digits(match))
    return (n >= low) & (n <= high)


def _small_parts(match: Column) -> Column:
    parts = F.split(match, r"\.")
    return F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.ltrim(p, F.lit("0")), F.lit("999")), F.lit(0)) <= 255))


def candidates(text: Column) -> Column:
    """All base spans and candidates of the text with votes and shape."""
    text = F.coalesce(text, F.lit(""))
    number = text.rlike("[0-9]")
    never = lambda m: F.lit(False)
    always = lambda m: F.lit(True)
    domain = lambda m: F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS)
    routable = lambda m: ~m.rlike(r"^0*(?:0|10|127|2[3-5][0-9])\.|^0*169\.254\.|^0*192\.168\.")
    issuer = lambda m: digits(m).rlike(ISSUERS)
    code = lambda m: m.rlike(DIALLING)
    card = lambda m: F.when(_between(m, 12, 19), luhn(digits(m))).otherwise(F.lit(False))
    return F.concat(
        _rows(found(text, EMAIL, text.contains("@")), "email", always, never, domain),
        _rows(found(text, SPELLED, text.rlike(r"(?i)[(\[{]at[)\]}]")), "email", never, always, domain),
        _rows(found(text, IP, number), "ip", _small_parts, never, routable),
        _rows(found(text, CARD, number), "card", card, lambda m: _between(m, 15, 16) & m.rlike("^[0-9]{4}[ -]?[0-9]{4}"), issuer),
        _rows(found(text, PHONE, text.contains("+")), "phone", lambda m: _between(m, 9, 15), never, code),
        _rows(found(text, LOCAL_PHONE, number), "phone", never, always, code),
    )


VOTES = ("v_pattern", "v_list", "v_words")
SHAPE = ("f_digits", "f_signs", "f_left", "f_right")


def vote_probabilities(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, votes, p): expectation-maximisation over (kind, votes, n), labelers independent given the truth."""
    total = sum((F.col(v) for v in VOTES), F.lit(0))
    start = F.when(total > 0, 0.9).when(total < 0, 0.1).otherwise(0.5)
    rows = written(counts.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")).withColumn("p", start), "pii-votes")
    kind = Window.partitionBy("kind")
    for _ in range(rounds):
        yes, no = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        odds = F.log((F.sum(yes).over(kind) + 1) / (F.sum(no).over(kind) + 1))
        for v in VOTES:
            same = Window.partitionBy("kind", v)
            odds = odds + F.log((F.sum(yes).over(same) + 1) / (F.sum(yes).over(kind) + 3))
            odds = odds - F.log((F.sum(no).over(same) + 1) / (F.sum(no).over(kind) + 3))
        rows = written(rows.withColumn("p", 1 / (1 + F.exp(-odds))), "pii-votes")
    return rows


def train(docs: DataFrame) -> list[tuple[str, float]]:
    """("kind|feature|value", log odds) of the span classifier; "kind||" is the prior."""
    spans = docs.select(F.explode(candidates(F.col("text"))).alias("x")).select("x.*")
    counts = written(spans.groupBy("kind", *VOTES, *SHAPE).agg(F.count(F.lit(1)).alias("n")), "pii-counts")
    soft = counts.join(vote_probabilities(counts).drop("n"), ["kind", *VOTES])
    soft = soft.withColumn("yes", F.col("n") * F.col("p")).withColumn("no", F.col("n") * (1 - F.col("p")))
    sums = soft.groupBy("kind").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    features = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("int").alias("v")) for f in (*VOTES, *SHAPE)])
    each = soft.select("kind", "yes", "no", F.explode(features).alias("x")).groupBy("kind", "x.f", "x.v").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    weights = each.join(sums, "kind").select(
        F.concat_ws("|", "kind", "f", "v").alias("k"),
        F.log(((F.col("yes") + 1) / (F.col("all_yes") + 8)) / ((F.col("no") + 1) / (F.col("all_no") + 8))).alias("w"),
    )
    prior = sums.select(F.concat(F.col("kind").cast("string"), F.lit("||")).alias("k"), F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("w"))
    return sorted(tuple(r) for r in weights.unionByName(prior).collect())  # kinds x features x buckets at most


def spans_of(text: Column, model: list[tuple[str, float]], sure: float = SURE) -> Column:
    """array<struct<start, kind, end, base>> in order of start, kind and end: base spans and those the classifier adds."""
    weights = F.create_map(*[x for k, w in model for x in (F.lit(k), F.lit(float(w)))]) if model else None

    def weight(x: Column, feature: str) -> Column:
        value = x[feature].cast("string") if feature else F.lit("")
        key = F.concat_ws("|", x["kind"].cast("string"), F.lit(feature), value)
        return F.coalesce(F.try_element_at(weights, key), F.lit(0.0)) if model else F.lit(0.0)

    def added(x: Column) -> Column:
        odds = sum((weight(x, f) for f in (*VOTES, *SHAPE)), weight(x, ""))
        return x["base"] | (F.lit(bool(model)) & (1 / (1 + F.exp(-odds)) > sure))

    chosen = F.filter(candidates(text), added)
    return F.array_sort(F.transform(chosen, lambda x: F.struct(x["start"], x["kind"], x["end"], x["base"])))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    texts = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(texts, ",")


def _is_kind(kind: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the numbers of base spans per kind, base_sha256, spans, n_added."""
    model = train(docs)
    rows = docs.select("doc_id", spans_of(F.col("text"), model).alias("_all"))
    rows = rows.withColumn("_base", F.filter("_all", lambda x: x["base"]))
    counts = {f"n_{k}": F.size(F.filter("_base", _is_kind(i))).cast("long") for i, k in enumerate(KINDS)}
    return rows.select(
        "doc_id", *[c.alias(k) for k, c in counts.items()], F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.col("_all")).alias("spans"), (F.size("_all") - F.size("_base")).cast("long").alias("n_added"),
    )


def _running_max(values: Column, block: int = 64) -> Column:
    """Inclusive running maxima of an array, block by block, so that no state grows with every element."""

    def run(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / block).cast("int")
        tops = F.transform(F.sequence(F.lit(0), last), lambda b: F.array_max(F.slice(v, b * block + 1, block)))
        before = F.aggregate(tops, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.greatest(F.element_at(acc, -1), x)))

        def at(base: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                b = F.floor(i / block).cast("int")
                return F.greatest(F.get(base, b), F.array_max(F.slice(v, b * block + 1, i - b * block + 1)))

            return F.transform(v, one)

        return bind(before, at)

    return F.when(F.size(values) > 0, bind(values, run)).otherwise(values)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, of the first one's kind.

    Linear in the text and its spans: the places come from running maxima of ends, and pieces are cut from four bytes a
    character, where a place is found without reading what is before it.
    """
    model = train(docs)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(bound: Column) -> Column:
        wide, spans, seen = bound["w"], bound["s"], bound["m"]

        def piece(low: Column, size: Column) -> Column:
            return F.decode(F.substring(wide, (low * 4 + 1).cast("int"), (size * 4).cast("int")), "UTF-32")

        def part(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(seen, i - 1))
            return F.when(before <= x["start"], F.concat(piece(before, x["start"] - before), F.get(names, x["kind"]))).otherwise(F.lit(""))

        last = F.element_at(seen, -1)
        return F.concat(F.array_join(F.transform(spans, part), ""), piece(last, F.octet_length(wide) / 4 - last))

    def merged(bound: Column) -> Column:
        seen = _running_max(F.transform(bound["s"], lambda x: x["end"].cast("long")))
        return bind(F.struct(F.encode(bound["t"], "UTF-32").alias("w"), bound["s"].alias("s"), seen.alias("m")), cut)

    found = F.struct(F.col("text").alias("t"), spans_of(F.col("text"), model).alias("s"))
    clean = bind(found, lambda b: F.when(F.size(b["s"]) > 0, merged(b)).otherwise(b["t"]))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), clean))
