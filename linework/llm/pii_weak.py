"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from patterns: the strict forms of four kinds, looser ones of theirs (spelled-out addresses, numbers
without a country code, long network addresses), and kinds that have no strict form (bank accounts, national
identity numbers, secrets). Labelers vote on each candidate, or abstain: the strict pattern, a checksum or range, a
gazetteer of mail hosts, network ranges and known prefixes, words of the context before it, and the characters around it.
Expectation-maximisation estimates each labeler's reliability per kind from how votes agree, with no labelled data. Its
posteriors train the final span classifier, a naive Bayes over features of the span, which decides the looser
candidates; strict spans always stay.

Texts are read once, and a candidate's row carries its own context only; places are running sums over a text's gaps and
matches, so work is linear in a text's matches. Vote patterns and feature values are finite however many documents there are, so
what reaches the driver is bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.llm.common import documents, parted, stored, text_key, whole_row

KINDS = ("email", "ip", "card", "phone")
#: Kinds whose spans are all the method's own.
ADDED = ("iban", "ssn", "secret")
#: The strict forms, as possessive patterns that match what the plain ones do in one pass over a text.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+-])(?=[A-Za-z_+-]*+[0-9])(?=[0-9_+-]*+[A-Za-z])[A-Za-z0-9_+-]{20,}+",
}
#: A text that does not have this has no match of the kind.
GATE = {
    "email": r"@|\(at\)|\[at\]| at [A-Za-z0-9-]++ dot ", "ip": r"[0-9]\.[0-9]++\.[0-9]|:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]|[0-9]{3}\)?[ .-][0-9]{3}",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "secret": r"[A-Za-z0-9_+-]{20}",
}
#: Words that stand before data of a kind; and hosts, ranges, numbering plans and prefixes that such data has.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:ip|host|server|address|addr|client|login)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|credit|debit|carte|tarjeta|karte)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|ring|whatsapp|telefon|téléphone|teléfono)\W*(?:\w+\W+){0,2}$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta|bank)\W*(?:\w+\W+){0,2}$",
    "ssn": r"(?i)(?:ssn|social|security|identity|taxpayer|id)\W*(?:\w+\W+){0,2}$",
    "secret": r"(?i)(?:token|secret|key|passw\w*|pwd|auth\w*|bearer|credentials?)\W*(?:\w+\W+){0,1}$",
}
GAZETTEER = {
    "email": r"(?i)(?:gmail|yahoo|hotmail|outlook|proton|icloud|aol|gmx|mail)[a-z0-9-]*(?: ?(?:\.|\(dot\)|\[dot\]|dot) ?[a-z0-9-]+)+$|(?:\.|dot\W{0,2})(?:com|org|net|edu|gov|io|de|fr|es|uk)$",
    "ip": r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.|^(?i:fe80|fd[0-9a-f]{2}|2[0-9a-f]{3}):",
    "card": r"^[3456][0-9]",
    "phone": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]|^\+(?:1|33|34|44|49)\b",
    "iban": r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|PL|SE|NO|DK|FI|LU)",
    "ssn": r"^[0-7]",
    "secret": r"^(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abp]-|[sp]k[-_])|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
}
#: Ends of host names: general ones and countries'.
TOP_LEVEL = r"(?i)[^a-z](?:com|org|net|edu|gov|mil|int|info|biz|[a-z]{2})$"
LABELERS = ("strict", "valid", "gazetteer", "context", "edges")
CONTEXT_CHARS = 40
ROUNDS = 30
ACCEPT = 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).try_cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, double).otherwise(d)

    return (n > 0) & (F.aggregate(F.transform(at, worth), F.lit(0), lambda a, x: a + x) % 10 == 0)


def _holds(kind: str, text: Column) -> Column:
    """Whether a match of a strict pattern is of its kind."""
    digits = _digits(text)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+(?=.)", "")).between(1, 3) & (F.coalesce(F.substring(F.regexp_replace(x, "^0+(?=.)", ""), 1, 3).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    return F.length(digits).between(9, 15)


def iban_holds(text: Column) -> Column:
    """Whether a bank account's number leaves 1 modulo 97, its first four characters taken last and letters as 10 to 35."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, x: Column) -> Column:
        return F.when(x.between("0", "9"), (rest * 10 + x.try_cast("int")) % 97).otherwise((rest * 100 + F.ascii(x) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, x: F.when(x == "", rest).otherwise(add(rest, x)).cast("int")) == 1


ITEM = "struct<kind:string,strict:boolean,pos:int,gap:int,gap_bytes:int,body:string,before:string,after:string>"


def matches(text: Column, pattern: str, kind: str, strict: bool) -> Column:
    """A pattern's matches, leftmost and not overlapping, each with the size of the gap before it, the gap's end and the character after."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("between"))

    def of(s: Column) -> Column:
        n = F.size(s["found"])

        def item(i: Column) -> Column:
            gap = F.get(s["between"], i)
            return F.struct(
                F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.alias("pos"), F.length(gap).alias("gap"), F.octet_length(gap).alias("gap_bytes"), F.get(s["found"], i).alias("body"),
                F.right(gap, F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(s["between"], i + 1), F.lit(1)).alias("after"),
            ).cast(ITEM)

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), item)).otherwise(F.array().cast(f"array<{ITEM}>"))

    return F.flatten(F.transform(F.array(both), of))


def _candidates(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, kind, strict, start, stop, b_start, b_stop, body, before, after) of every candidate; stops are exclusive, b_ is in bytes.

    The context before ends at the match before it of the same pattern.
    """
    none = F.array().cast(f"array<{ITEM}>")
    every = []
    for kind in KINDS + ADDED:
        found = [matches(F.col("text"), table[kind], kind, strict) for strict, table in ((True, STRICT), (False, LOOSE)) if kind in table]
        every.append(F.when(F.col("text").rlike(GATE[kind]), F.concat(*found)).otherwise(none))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # before the matches are parted, as they share it
    hits = numbered.select("row", "doc_id", "text_key", F.explode(F.concat(*every)).alias("m")).select("row", "doc_id", "text_key", "m.*")
    upto = Window.partitionBy("row", "kind", "strict").orderBy("pos")
    stop, b_stop = F.sum(F.col("gap") + F.length("body")).over(upto), F.sum(F.col("gap_bytes") + F.octet_length("body")).over(upto)
    placed = hits.withColumns({"stop": stop.cast("int"), "b_stop": b_stop.cast("int")})
    return placed.select("doc_id", "text_key", "kind", "strict", (F.col("stop") - F.length("body")).alias("start"), "stop", (F.col("b_stop") - F.octet_length("body")).alias("b_start"), "b_stop", "body", "before", "after")


def _by_kind(value, default: Column) -> Column:
    out = default
    for kind in KINDS + ADDED:
        out = F.when(F.col("kind") == kind, value(kind)).otherwise(out)
    return out


def _voted(spans: DataFrame) -> DataFrame:
    """Votes of the labelers: 1, 0 or -1 (abstains); and the classifier's features."""
    body, digits = F.col("body"), _digits(F.col("body"))

    def checked(kind: str) -> Column:
        if kind == "iban":
            return iban_holds(body).cast("int")
        if kind == "ssn":
            return (~body.rlike("^(?:000|666|9)|-00-|-0000$")).cast("int")
        if kind == "secret":  # neither a word with a number nor a number with a letter
            return (F.length(digits).between(3, F.length(body) - 3)).cast("int")
        loose = F.lit(1)
        if kind == "phone":
            loose = F.length(digits).between(9, 15).cast("int")
        if kind == "email":
            loose = body.rlike(TOP_LEVEL).cast("int")
        return F.when(F.col("strict"), _holds(kind, body).cast("int")).otherwise(loose)

    valid = _by_kind(checked, F.lit(-1))
    listed = _by_kind(lambda kind: F.when(body.rlike(GAZETTEER[kind]), 1).otherwise(F.lit(-1 if kind != "email" else 0)), F.lit(-1))
    near = _by_kind(lambda kind: F.when(F.col("before").rlike(CONTEXT[kind]), 1).otherwise(-1), F.lit(-1))
    joined = F.col("before").rlike(r"[\p{L}\p{N}_]$") | F.col("after").rlike(r"[\p{L}\p{N}_]")
    return spans.withColumns(
        {
            "strict_vote": F.when(F.col("kind").isin(*ADDED), -1).otherwise(F.col("strict").cast("int")), "valid": valid, "gazetteer": listed, "context": near, "edges": F.when(joined, 0).otherwise(1),
            "size": F.least(F.length(body), F.lit(40)) / 4, "share": F.ceil(F.length(digits) * 4 / F.length(body)), "left": F.when(F.col("before") == "", "^").when(F.col("before").rlike(r"\s$"), "_").when(F.col("before").rlike(r"[\p{L}\p{N}]$"), "w").otherwise("."),
        }
    ).withColumn("size", F.floor("size").cast("int")).withColumn("share", F.col("share").cast("int"))


VOTES = ("strict_vote", "valid", "gazetteer", "context", "edges")
FEATURES = ("size", "share", "left", "near", "joined")


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """Prior, (P(1 | personal), P(1 | not)) of each labeler, and the posterior of each vote pattern, by EM.

    patterns: votes and how often they occur. Starts from labelers that are right in four votes of five; one count of
    smoothing keeps estimates inside (0, 1).
    """
    n = len(patterns[0][0]) if patterns else 0
    prior, rates = 0.5, [(0.8, 0.2)] * n
    posterior: dict[tuple[int, ...], float] = {}

    def expect() -> None:
        for votes, _ in patterns:
            log = math.log(prior) - math.log(1 - prior)
            for v, (p, q) in zip(votes, rates, strict=True):
                if v >= 0:
                    log += math.log(p / q) if v else math.log((1 - p) / (1 - q))
            posterior[votes] = 1 / (1 + math.exp(-max(-50.0, min(50.0, log))))

    for _ in range(rounds):
        expect()
        total = sum(c for _, c in patterns)
        mass = sum(c * posterior[v] for v, c in patterns)
        prior = min(0.99, max(0.01, (mass + 1) / (total + 2)))
        new = []
        for k in range(n):
            said = [(v[k], posterior[v], c) for v, c in patterns if v[k] >= 0]
            yes, no = sum(p * c for _, p, c in said), sum((1 - p) * c for _, p, c in said)
            p = (sum(x * w * c for x, w, c in said) + 8) / (yes + 10)
            q = (sum(x * (1 - w) * c for x, w, c in said) + 2) / (no + 10)
            new.append((p, q))
        rates = new
    expect()
    return prior, rates, posterior


def train(spans: DataFrame) -> dict[str, dict]:
    """Per kind: prior, labeler rates and the classifier's log odds of each feature value."""
    seen = spans.groupBy("kind", *VOTES, *FEATURES).agg(F.count("*").alias("n")).collect()
    models = {}
    for kind in KINDS + ADDED:
        rows = [r for r in seen if r["kind"] == kind]
        counts: dict[tuple[int, ...], int] = {}
        for r in rows:
            votes = tuple(r[v] for v in VOTES)
            counts[votes] = counts.get(votes, 0) + r["n"]
        prior, rates, posterior = reliabilities(sorted(counts.items()))
        total = sum(r["n"] for r in rows)
        yes = sum(r["n"] * posterior[tuple(r[v] for v in VOTES)] for r in rows)
        weights: dict[str, dict[str, float]] = {}
        for f in FEATURES:
            at: dict[str, list[float]] = {}
            for r in rows:
                p = posterior[tuple(r[v] for v in VOTES)]
                pair = at.setdefault(str(r[f]), [0.0, 0.0])
                pair[0] += r["n"] * p
                pair[1] += r["n"] * (1 - p)
            k = len(at)
            weights[f] = {x: math.log((a + 1) / (yes + k)) - math.log((b + 1) / (total - yes + k)) for x, (a, b) in sorted(at.items())}
        models[kind] = {"prior": math.log((yes + 1) / (total - yes + 1)), "rates": dict(zip(LABELERS, rates, strict=False)), "weights": weights}
    return models


def _log_odds(models: dict[str, dict]) -> Column:
    def of(kind: str) -> Column:
        out = F.lit(models[kind]["prior"])
        for f in FEATURES:
            term = F.lit(0.0)
            for value, w in models[kind]["weights"][f].items():
                term = F.when(F.col(f).cast("string") == value, w).otherwise(term)
            out = out + term
        return out

    return _by_kind(of, F.lit(-50.0))


def spans(docs: DataFrame, models: dict[str, dict] | None = None) -> DataFrame:
    """(doc_id, text_key, kind, start, stop, b_start, b_stop, base, score) of all personal data: strict spans that hold, and others that
    the classifier accepts where they overlap no strict span of their kind. Trains on docs unless models are given.

    Rows that repeat a doc_id and text have their spans once.
    """
    rows = documents(docs).withColumn("text_key", text_key())
    found = _voted(_candidates(rows)).withColumn("near", F.col("context")).withColumn("joined", F.col("edges"))
    found = stored(found.select("doc_id", "text_key", "kind", "strict", "start", "stop", "b_start", "b_stop", *VOTES, *FEATURES).distinct(), "candidates")
    models = models or train(found)
    scored = found.withColumn("score", 1 / (1 + F.exp(-_log_odds(models)))).withColumn("base", F.col("strict") & (F.col("valid") == 1))
    kept = scored.where(F.col("base") | (~F.col("strict") & (F.col("valid") == 1) & (F.col("score") >= ACCEPT)))
    # Nearest strict spans on both sides, by a sort of a text's spans for each.
    kept = kept.repartition("doc_id", "text_key")
    text = Window.partitionBy("doc_id", "text_key", "kind")
    upward, downward = (text.orderBy(start, F.col("base").desc()).rowsBetween(Window.unboundedPreceding, 0) for start in (F.col("start"), F.col("start").desc()))
    before = F.max(F.when(F.col("base"), F.col("stop"))).over(upward)
    after = F.min(F.when(F.col("base"), F.col("start"))).over(downward)
    met = (F.coalesce(before, F.lit(0)) > F.col("start")) | (F.coalesce(after, F.col("stop")) < F.col("stop"))
    clear = kept.withColumn("met", ~F.col("base") & met).where("not met")
    return clear.select("doc_id", "text_key", "kind", "start", "stop", "b_start", "b_stop", "base", "score")


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _equals(kind: str):
    return lambda x: x == kind


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), n_spans (all), base_sha256, spans.

    Null text counts as empty and has no spans; rows that repeat a doc_id, null ones too, give a row each, by their own texts;
    a text may be of any length and have any number of spans; extra columns are ignored; an empty table gives no rows.
    """
    order = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS + ADDED) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    lists = spans(docs).groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_list(F.struct("start", order.alias("o"), "stop", "kind", "base")).alias("items"))
    rows = documents(docs).select("doc_id", text_key().alias("text_key"))
    met = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    items = F.coalesce("items", F.array().cast("array<struct<start:int,o:int,stop:int,kind:string,base:boolean>>"))
    base = F.filter(items, lambda x: x["base"])
    counts = [F.size(F.filter(F.transform(base, lambda x: x["kind"]), _equals(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return met.select("doc_id", *counts, F.size(items).cast("long").alias("n_spans"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(items).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data in text replaced by its kind in brackets; other columns stay as they are.

    Of spans that overlap the first names the kind, and all they cover goes. Rows that repeat a doc_id go by their own texts.
    """
    order = Window.partitionBy("doc_id", "text_key").orderBy("b_start", "b_stop", "kind")
    upto = F.coalesce(F.max("b_stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hidden = spans(docs).withColumn("upto", upto)
    first = F.struct("b_start", "upto", "kind")
    lists = hidden.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.array_sort(F.collect_list(F.when(F.col("b_start") >= F.col("upto"), first))).alias("_items"), F.max("b_stop").alias("_end"))
    lists = stored(lists, "personal")
    near, far = parted(docs, F.col("doc_id").cast("long"), lists, "_d", lists.count())
    keyed = near.select(whole_row(near).alias("row"), F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"))
    met = keyed.join(lists, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    # Slices of bytes, each taken once: what lies between hidden stretches, and after the last.
    whole = F.struct(F.col("row.text").cast("string").cast("binary").alias("raw"), "_items", "_end")

    def shown(s: Column) -> Column:
        parts = F.transform(s["_items"], lambda x: F.concat(F.substring(s["raw"], x["upto"] + 1, x["b_start"] - x["upto"]).cast("string"), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.substring(s["raw"], s["_end"] + 1, F.octet_length(s["raw"])).cast("string"))

    text = F.when(F.col("_items").isNull(), F.col("row.text")).otherwise(F.element_at(F.transform(F.array(whole), shown), 1))
    return met.select(*[text.cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(far)
