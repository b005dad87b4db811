"""Personal data by weak supervision.

Base patterns find emails, IP addresses, card and phone numbers; looser patterns propose more
candidates of each kind, and secrets (keys, tokens, passwords). Labelers (the strict pattern,
checksums, gazetteers, cue words before the span, the shape of its digits, its layout) vote 1,
-1 or 0 (abstain) on every candidate. Expectation
maximisation over the counts of vote patterns estimates each labeler's reliability by kind;
the posteriors then weigh a naive Bayes span classifier over votes, cue words and shapes,
which decides on the candidates that the base patterns don't hold for certain.

Everything that touches rows is a DataFrame operation. The driver sees counts only: of vote
patterns (at most kinds * 3**LABELERS) and of hashed features (at most FEATURES * kinds).
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import materialize

#: The contract's kinds, and one more whose spans stand in columns of their own.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: Possessive forms of the contract's patterns: as what follows a run can't be part of it,
#: they match the same spans without backtracking. A match that could start within a run
#: starts at the run's head, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Looser candidates, each under the kind that it would be: emails with spelled signs, IPv6 and
#: bracketed IPv4 addresses, card numbers of 13 to 15 digits, national phone numbers.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,4}"
LOOSE_IP4 = r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9.])"
LOOSE_IP6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,45}[0-9])(?=(?:[0-9A-Fa-f]{0,4}:){3})(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])"
LOOSE_CARD = r"(?<![0-9A-Za-z+])(?<![0-9][ .,-])[0-9](?:[ -]?[0-9]){12,14}+(?![0-9A-Za-z])(?![ .,-][0-9])"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|00[1-9](?:[ ()-]?[0-9]){8,13}+)(?![0-9A-Za-z.-])"
SECRETS = (
    r"(?<![A-Za-z0-9])(?:(?i:api[_-]?key|access[_-]?key|client[_-]?secret|secret(?:[_-]?key)?|auth[_-]?token|token|passw(?:or)?d|pwd)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?[A-Za-z0-9_/+=.-]{8,}+"
    r"|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"
)
#: (kind, base or not, pattern, a cheap test that any match passes)
PATTERNS = (
    ("email", True, EMAIL, lambda t: F.contains(t, F.lit("@"))),
    ("ip", True, IP, lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\."))),
    ("card", True, CARD, lambda t: F.rlike(t, F.lit(r"[0-9](?:[ -]?[0-9]){15}"))),
    ("phone", True, PHONE, lambda t: F.rlike(t, F.lit(r"\+[0-9]"))),
    ("email", False, LOOSE_EMAIL, lambda t: F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]"))),
    ("ip", False, LOOSE_IP4, lambda t: F.rlike(t, F.lit(r"[0-9] ?[\[(](?:\.|dot)[\])]"))),
    ("ip", False, LOOSE_IP6, lambda t: F.rlike(t, F.lit(r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:"))),
    ("card", False, LOOSE_CARD, lambda t: F.rlike(t, F.lit(r"[0-9](?:[ -]?[0-9]){12}"))),
    ("phone", False, LOOSE_PHONE, lambda t: F.rlike(t, F.lit(r"[0-9][ .-][0-9]{4}|00[1-9]"))),
    (SECRET, False, SECRETS, lambda t: F.rlike(t, F.lit(r"(?i:key|secret|token|passw|pwd)[\"']?[ \t]{0,3}[:=]|AKIA|gh[pousr]_|xox[abprs]-|PRIVATE KEY"))),
)
#: Gazetteers: top-level domains (generic ones, and of countries where most mail is), issuers'
#: first digits, calling codes, special address blocks.
TLDS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "io", "info", "biz", "name", "pro", "dev", "app", "me", "tv", "cc", "co", "ai", "xyz", "online", "site", "shop", "cloud", "example",
    "de", "fr", "es", "uk", "eu", "it", "nl", "be", "ch", "at", "se", "no", "dk", "fi", "pl", "cz", "pt", "gr", "ie", "hu", "ro", "ru", "ua", "tr",
    "us", "ca", "mx", "br", "ar", "cl", "cn", "jp", "kr", "in", "id", "my", "sg", "th", "vn", "ph", "tw", "hk", "au", "nz", "za", "eg", "ng", "ke", "il", "ae", "sa", "ir", "pk",
)
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|34|37|6011|64|65|35|30|36|38|39|50|5[6-8]|62|67)"
CALLING = r"^(?:00)?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
SPECIAL_IP = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^(?i:fe80|ff|::1$|2001:db8)"
#: Cue words in the CONTEXT characters before a span.
CONTEXT = 40
CUES = r"(?i)\b(?:e-?mail|mail|contact|call|phone|tel|telefon|fax|mobile|card|visa|mastercard|amex|credit|debit|payment|konto|account|ip|host|server|address|adresse|reach|write|login|credentials|config)\b"
COUNTER_CUES = r"(?i)\b(?:version|order|isbn|issn|ean|invoice|ref|serial|section|figure|table|tracking|timestamp|no)\b"
#: How card numbers are written: in one run, or in the issuers' groups.
CARD_LAYOUT = r"^(?:[0-9]{14,16}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -]?[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
LABELERS = ("strict", "checksum", "gazetteer", "context", "shape", "layout")
FEATURES = 4096
ROUNDS = 50
#: Prior of a labeler's vote being right, and its weight as a share of the labeler's votes.
RIGHT, TRUST = 0.8, 0.05
#: Spans that a feature's overall rate counts as, in the span classifier.
SHRINK = 10.0


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.reverse(F.filter(F.split(digits, ""), lambda d: d != ""))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: Column, base: Column, span: Column) -> Column:
    """What is asked of a base match, by the contract, and of a loose card besides its pattern."""
    digits = _digits(span)
    n = F.length(digits)
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?+"
    ip = F.rlike(span, F.lit(rf"^{part}\.{part}\.{part}\.{part}$"))
    return F.when(kind == "ip", ip).when(kind == "card", F.when(n.between(F.when(base, 16).otherwise(13), F.when(base, 19).otherwise(15)), luhn(digits)).otherwise(False)).when(kind == "phone", n.between(8, 15)).otherwise(True)


def _matches(text: Column, number: int, pattern: str, may: Column) -> Column:
    """Structs of each match and of the text before it since the last match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    rows = F.transform(found, lambda m, i: F.struct(F.lit(number).alias("pattern"), i.alias("nth"), F.length(F.get(pieces, i)).alias("gap"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"), m.alias("span")))
    return F.when(may, rows).otherwise(F.lit(None))


def _votes(df: DataFrame) -> DataFrame:
    """Columns v0..: each labeler's vote on a candidate."""
    kind, base, span, digits = F.col("kind"), F.col("base"), F.col("span"), _digits(F.col("span"))
    six = F.contains(span, F.lit(":"))
    plain = F.regexp_replace(span, r" ?[\[(](?:\.|dot)[\])] ?", ".")
    part = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    value = F.regexp_extract(span, r"([A-Za-z0-9_/+=.-]+)$", 1)
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    either = lambda ok, other=no: F.when(ok, yes).otherwise(other)
    strict = either(base, none)
    checksum = (
        F.when(kind == "card", either(luhn(digits)))
        .when((kind == "ip") & six, either(F.rlike(span, F.lit(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")), none))
        .when(kind == "ip", either(F.rlike(plain, F.lit(rf"^{part}(?:\.{part}){{3}}$"))))
        .when(kind == "phone", either(F.length(digits).between(10, 13)))
        .when(kind == SECRET, F.when(~F.rlike(value, F.lit("[0-9]")), no).when((F.length(value) >= 16) & F.rlike(value, F.lit("[A-Za-z]")), yes).otherwise(none))
        .otherwise(none)
    )
    last = F.lower(F.regexp_extract(span, r"([A-Za-z0-9-]+)$", 1))
    gazetteer = (
        F.when(kind == "email", either(last.isin(*TLDS)))
        .when(kind == "card", either(F.rlike(digits, F.lit(ISSUERS)), none))
        .when(kind == "phone", either(F.when(base | F.startswith(digits, F.lit("00")), F.rlike(digits, F.lit(CALLING))).otherwise(F.rlike(digits, F.lit("^[2-9]")))))
        .when(kind == "ip", F.when(F.rlike(plain, F.lit(SPECIAL_IP)), no).otherwise(yes))
        .when(kind == SECRET, either(F.rlike(span, F.lit("^(?:AKIA|gh[pousr]_|xox|-----)")), none))
    )
    context = F.when(F.rlike("before", F.lit(COUNTER_CUES)), no).when(F.rlike("before", F.lit(CUES)), yes).otherwise(none)
    shape = F.when(F.rlike(digits, F.lit(r"([0-9])\1{5}")) | F.contains(digits, F.lit("123456")) | (six & (digits == "")), no).otherwise(none)
    alone = either(~F.rlike("before", F.lit(r"[\p{L}\p{N}]$")))
    layout = F.when(kind == "card", either(F.rlike(span, F.lit(CARD_LAYOUT)))).otherwise(alone)
    return df.withColumns({f"v{i}": F.when(kind.isNotNull(), v).cast("int") for i, v in enumerate((strict, checksum, gazetteer, context, shape, layout))})


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = ROUNDS) -> tuple[dict[str, float], dict[tuple[str, int, int, int], float]]:
    """Expectation maximisation over counts of (kind, votes): each kind's share of true spans,
    and P(vote | truth, it votes) by (kind, labeler, vote, truth). Abstaining says nothing.
    Started from the majority, and held by a prior that labelers tell the truth (RIGHT of the
    time, with the weight of TRUST of their votes), so that truth 1 is what the votes speak for."""
    weight = {k: 1 / (1 + math.exp(-sum(k[1]))) for k in counts}
    prior: dict[str, float] = {}
    table: dict[tuple[str, int, int, int], float] = {}
    for _ in range(rounds):
        mass, seen = defaultdict(float), defaultdict(float)
        for (kind, votes), n in counts.items():
            for truth, w in ((1, weight[kind, votes]), (0, 1 - weight[kind, votes])):
                mass[kind, truth] += n * w
                for i, v in enumerate(votes):
                    seen[kind, i, v, truth] += n * w
        for kind, _ in counts:
            prior[kind] = (mass[kind, 1] + 1) / (mass[kind, 1] + mass[kind, 0] + 2)
            for i in range(len(LABELERS)):
                trust = 2 + TRUST * sum(seen[kind, i, v, truth] for v in (-1, 1) for truth in (0, 1))
                for truth in (0, 1):
                    spoken = seen[kind, i, 1, truth] + seen[kind, i, -1, truth]
                    for v in (-1, 1):
                        right = RIGHT if (v == 1) == (truth == 1) else 1 - RIGHT
                        table[kind, i, v, truth] = (seen[kind, i, v, truth] + trust * right) / (spoken + trust)
        weight = {k: posterior(*k, prior, table) for k in counts}
    return prior, table


def posterior(kind: str, votes: tuple[int, ...], prior: dict, table: dict) -> float:
    """P(true | votes) under the labelers' reliabilities."""
    odds = math.log(prior[kind] / (1 - prior[kind]))
    for i, v in enumerate(votes):
        if v:
            odds += math.log(table[kind, i, v, 1] / table[kind, i, v, 0])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _features() -> list[Column]:
    """The classifier's features of a span, hashed: kind with length, shape, cue and votes."""
    cue = F.lower(F.regexp_extract("before", r"([\p{L}]+)[^\p{L}]*$", 1))
    shape = F.regexp_replace(F.regexp_replace("span", r"[0-9]+", "9"), r"[A-Za-z]+", "a")
    parts = [F.concat(F.lit("n"), F.least(F.length("span"), F.lit(40))), F.concat(F.lit("s"), F.left(shape, F.lit(24))), F.concat(F.lit("c"), cue)]
    parts += [F.concat(F.lit(f"v{i}:"), F.col(f"v{i}")) for i in range(len(LABELERS))]
    return [F.pmod(F.xxhash64(F.lit(i), p), F.lit(FEATURES)).cast("int") for i, p in enumerate(parts)]


def _literal(values: list[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), "array<double>")


def candidates(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Every candidate with its place and votes, and a row without a span for each row of
    ``docs`` that has none: ``rid, doc_id, kind, base, start, end, span, before, v0..``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).withColumn("rid", F.monotonically_increasing_id())
    lists = [F.coalesce(_matches(F.col("body"), n, p, may(F.col("body"))), F.array()) for n, (_, _, p, may) in enumerate(PATTERNS)]
    spans = rows.select("rid", "doc_id", F.explode_outer(F.concat(*lists)).alias("m")).select("rid", "doc_id", "m.*")
    upto = Window.partitionBy("rid", "pattern").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.length("span")).over(upto)).withColumn("start", F.col("end") - F.length("span"))
    kind = F.element_at(F.array(*[F.lit(p[0]) for p in PATTERNS]), F.col("pattern") + 1)
    base = F.element_at(F.array(*[F.lit(p[1]) for p in PATTERNS]), F.col("pattern") + 1)
    spans = spans.withColumns({"kind": F.when(F.col("pattern").isNotNull(), kind), "base": F.when(F.col("pattern").isNotNull(), base)})
    spans = spans.withColumn("ok", F.when(F.col("base") | (F.col("kind") == "card"), _valid(F.col("kind"), F.col("base"), F.col("span"))).otherwise(F.col("base").isNotNull()))
    # A match that fails its test is dropped; its row stays, as it may be its document's only one.
    spans = spans.withColumns({c: F.when(F.col("ok"), F.col(c)) for c in ("kind", "base", "start", "end", "span", "before")})
    return _votes(spans.drop("ok", "pattern", "nth", "gap"))


def classify(spans: DataFrame) -> DataFrame:
    """Add ``truth`` (EM's posterior) and ``score`` (the span classifier's log odds)."""
    votes = [f"v{i}" for i in range(len(LABELERS))]
    real = spans.filter(F.col("kind").isNotNull())
    counts = {(r["kind"], tuple(r[v] for v in votes)): r["count"] for r in real.groupBy("kind", *votes).count().collect()}
    prior, table = reliabilities(counts)
    odds, truth = F.lit(0.0), F.lit(None).cast("double")
    for kind in (*KINDS, SECRET):
        if kind in prior:
            odds = F.lit(math.log(prior[kind] / (1 - prior[kind])))
            for i, v in enumerate(votes):
                odds = odds + F.element_at(_literal([math.log(table[kind, i, x, 1] / table[kind, i, x, 0]) if x else 0.0 for x in (-1, 0, 1)]), F.col(v) + 2)
            truth = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))).otherwise(truth)
    spans = spans.withColumn("truth", truth)
    seen = spans.filter("kind IS NOT NULL").select("kind", "truth", F.explode(F.array(*_features())).alias("f")).groupBy("kind", "f").agg(F.sum("truth").alias("yes"), F.sum(1 - F.col("truth")).alias("no")).collect()
    mass = defaultdict(lambda: [0.0, 0.0])
    for (kind, pattern), n in counts.items():
        p = posterior(kind, pattern, prior, table)
        mass[kind][0] += n * p
        mass[kind][1] += n * (1 - p)
    score = F.lit(None).cast("double")
    for kind, (yes, no) in mass.items():
        weights = [0.0] * FEATURES  # what an unseen feature says
        for r in seen:
            if r["kind"] == kind:  # shrunk to the feature's own rate, so that rare ones say little
                rate = SHRINK * (r["yes"] + r["no"]) / (yes + no)
                weights[r["f"]] = math.log((r["yes"] + rate) / (yes + SHRINK)) - math.log((r["no"] + rate) / (no + SHRINK))
        line = F.lit(math.log((yes + 1) / (no + 1)))
        for f in _features():
            line = line + F.element_at(_literal(weights), f + 1)
        score = F.when(F.col("kind") == kind, line).otherwise(score)
    return spans.withColumn("score", score)


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans, added, secrets, n_spans``.

    ``n_*`` and ``base_sha256`` are of the base spans, which always stay; ``spans`` has those
    and the ``added`` candidates whose classifier score is above 0 and which overlap no base
    span. ``secrets`` has the spans of keys, tokens and passwords that the classifier takes;
    ``n_spans`` counts all of these. Places are code points, the end exclusive. Null and empty
    texts have no spans; repeated rows each get their row; an empty table gives no rows; other
    columns are ignored. A text's matches are rows, sorted once, until its spans are joined into
    the result, so very long texts cost time in proportion (but for the sort).
    """
    spans = materialize(candidates(docs, text, doc_id), "pii-spans")
    known = classify(spans)
    # Base spans that end behind a candidate's start, or start before its end, overlap it.
    at = Window.partitionBy("rid").orderBy(F.col("start").asc_nulls_last(), F.col("base").desc_nulls_last())
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(at.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))
    known = known.withColumns({"reach": reach, "ahead": ahead}).withColumn("kept", F.col("base") | ((F.col("score") > 0) & free))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    item = F.struct(order.alias("k"), F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "kind")
    private = F.col("kind") == SECRET
    text_of = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, item))), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    count = lambda which, name: F.count_if(F.coalesce(which, F.lit(False))).alias(name)
    return known.groupBy("rid", "doc_id").agg(
        *[count(F.col("base") & (F.col("kind") == k), f"n_{k}") for k in KINDS],
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
        text_of(F.col("kept") & ~private).alias("spans"),
        count(F.col("kept") & ~F.col("base") & ~private, "added"),
        text_of(F.col("kept") & private).alias("secrets"),
        count(F.col("kept"), "n_spans"),
    ).drop("rid")
