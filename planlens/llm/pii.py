"""Personal data in texts, by weak supervision, in Spark expressions only.

Fixed patterns give base spans (email, ip, card, phone), which always count.
Looser patterns give candidates. Labelers vote on a candidate (yes, no or
abstain): its shape, a checksum or digit count, a gazetteer of domains, calling
codes, card issuers and key prefixes, cue words before it, and what surrounds
it. Expectation-maximisation over the counts of vote patterns (a table of
bounded size) estimates how reliable each labeler is and how likely each
candidate is personal data; with these likelihoods as soft labels a final
classifier over features of the span is trained, as sums in Spark. A candidate
that it accepts and that no base span of its kind overlaps is added.

An address may be written out with brackets (``[at]``, ``(dot)``) or as words
(``name at host dot com``); a secret is a known kind of key or what stands behind
a name such as ``Password:``, with a blank around the sign if it holds a digit.
No pattern bounds the length of what it takes; each reads a long run once.

Texts are scanned once, for base spans and candidates; only spans are kept.
Null and empty texts have no spans. Repeated rows get a row each, other columns
are ignored, an empty table gives no rows. Positions count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.llm.columns import named
from planlens.workspace import Scratch

#: The base patterns, with lookbehinds so that long runs are read once.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
BASE_KINDS = tuple(BASE_PATTERNS)
KINDS = (*BASE_KINDS, "secret")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_BYTES = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Candidate patterns by kind; the first that matches at a place wins.
CANDIDATES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?: ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "secret": r"AKIA[0-9A-Z]{16}|(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{16,}+|sk-[A-Za-z0-9_-]{16,}+|xox[abeprs]-[A-Za-z0-9-]{8,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{4,}+)"
    r"|(?i:password|passwd|pwd|secret|token|api_?key)(?:[=:][^\s\"']{6,}+| ?[=:] ?(?=[^\s\"'0-9]*+[0-9])[^\s\"']{6,}+)|(?<=\")[0-9A-Fa-f]{32,}+(?=\")",
    "phone": r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}+(?![0-9])",
    "card": r"[0-9](?<![0-9][0-9])(?:[0-9]{3}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{12,18}+)(?![0-9])",
}
#: Gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420")
CARD_ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
KEY_PREFIXES = "^(?:AKIA|gh[pousr]_|sk-|xox|eyJ|(?i:password|passwd|pwd|secret|token|api_?key))"
CUES = r"(?i)(?:phone|tel|call|mobile|fax|contact|mail|card|visa|pay|account|user|login|key|pass|secret|token|telefon|konto|karte|kontakt|carte|compte|tarjeta|cuenta|correo|courriel)\S{0,12}\W{0,3}$"
COUNTER_CUES = r"(?i)(?:isbn|issn|order|invoice|ticket|version|page|commit|sha|md5|no\.|nr\.)\W{0,3}$"

#: How a candidate begins that is an address written out.
_WRITTEN_OUT = r"^[A-Za-z0-9._%+-]+(?: ?[\[({] ?at ?[\])}]| at )"

#: A text without a match of this has no span and no candidate.
MAY_HOLD = r"[0-9@=]|(?i:password|passwd|pwd|secret|token|api_?key):|\"[A-Fa-f]{32}|AKIA[A-Z]{16}|gh[pousr]_|sk-[A-Za-z_-]{16}|xox[abeprs]-|eyJ|[\[({] ?at ?[\])}]| dot [A-Za-z-]"

#: Values of the feature ``form``: shapes of spans share them by hash, so the classifier has few weights on any corpus.
FORMS = 512
LABELERS = ("shape", "check", "gazetteer", "context", "edges")
FEATURES = ("form", "long", "before_class", "after_class")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, m) of all matches of ``pattern``, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    paired = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def add(so_far: Column, x: Column) -> Column:
        start = so_far["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.array_append(so_far["spans"], span).alias("spans"))

    # the accumulator's type is that of its first value, so matches are never null
    return F.aggregate(paired, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda x: x["spans"])


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end) of the base spans, by kind as listed and by start."""
    valid = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(_BYTES),
        "card": lambda m: F.call_function("luhn_check", digits(m)),
        "phone": lambda m: F.length(digits(m)).between(8, 15),
    }
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def of(kind: str) -> Column:
        good = F.filter(matches(text, BASE_PATTERNS[kind]), lambda s: valid[kind](s["m"]))
        plain = F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(needs[kind], plain).otherwise(none)

    return F.concat(*(of(k) for k in BASE_KINDS))


def candidate_spans(text: Column) -> Column:
    """Array of candidates with votes and features."""
    every = "|".join(f"(?:{p})" for p in CANDIDATES.values())

    def describe(s: Column) -> Column:
        m = s["m"]
        kind = F.when(m.rlike(_WRITTEN_OUT), "email").when(m.startswith("+"), "phone").when(m.rlike("^[0-9][0-9 -]*$"), "card").otherwise("secret")
        before = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
        after = F.substring(text, s["end"] + 1, F.lit(2))
        return F.struct(
            kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), m.alias("m"), before.alias("before"), after.alias("after"),
        )

    def vote(c: Column) -> Column:
        m, kind, n = c["m"], c["kind"], F.length(digits(c["m"]))
        yes, no, abstain = F.lit(1), F.lit(-1), F.lit(0)
        either = lambda test: F.when(test, yes).otherwise(no)
        shape = F.when(kind == "email", yes).when(kind == "phone", either(m.rlike(r"^\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$"))).when(kind == "card", either(m.rlike("^(?:[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4})$"))).otherwise(either(m.rlike("[0-9]") & m.rlike("[A-Za-z]")))
        check = F.when(kind == "card", either(F.call_function("luhn_check", digits(m)))).when(kind == "phone", either(n.between(10, 13))).when(kind == "secret", either(F.length(m) >= 16)).otherwise(abstain)
        domain = F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1))
        code = F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)
        gazetteer = F.when(kind == "email", either(domain.isin(*DOMAINS))).when(kind == "phone", either(code.isin(*CALLING_CODES))).when(kind == "card", either(digits(m).rlike(CARD_ISSUERS))).otherwise(F.when(m.rlike(KEY_PREFIXES), yes).otherwise(abstain))
        context = F.when(c["before"].rlike(COUNTER_CUES), no).when(c["before"].rlike(CUES), yes).otherwise(abstain)
        clean = F.when(c["before"] == "", True).otherwise(c["before"].rlike("[\\s\"'(:=,;]$")) & ((c["after"] == "") | c["after"].rlike("^[\\s\"').,;:!?]"))
        form = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[A-Za-z]+", "a"), "(?:9a|a9|9|a){3,}", "x")
        side = lambda x: F.when(x == "", "edge").when(x.rlike("\\s"), "space").when(x.rlike("[0-9]"), "digit").when(x.rlike("[A-Za-z]"), "letter").otherwise("mark")
        return F.struct(
            kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            *(v.alias(name) for name, v in zip(LABELERS, (shape, check, gazetteer, context, either(clean)))),
            F.pmod(F.crc32(F.encode(form, "UTF-8")), F.lit(FORMS)).cast("string").alias("form"),
            F.least(F.length(m), F.lit(63)).bitwiseAND(-4).cast("string").alias("long"),
            side(F.substring(c["before"], -1, 1)).alias("before_class"), side(F.substring(c["after"], 1, 1)).alias("after_class"),
        )

    sound = lambda c: (c["kind"] != "card") | F.call_function("luhn_check", digits(c["m"]))  # noqa: E731  a failed checksum isn't a card
    return F.transform(F.filter(F.transform(matches(text, every), describe), sound), vote)


def fit_labelers(patterns: list[tuple], rounds: int = 50, start: float = 0.75, weight: float = 10.0) -> dict[tuple, float]:
    """Likelihood of being personal data for each (kind, votes...) pattern, by EM over its counts.

    A labeler of a kind has an accuracy: how often it is right where it doesn't
    abstain. Accuracies start from ``start`` with ``weight`` votes behind it and
    stay better than chance.
    """
    kinds = sorted({p[0] for p, _ in patterns})
    share = dict.fromkeys(kinds, 0.5)
    right = {(k, j): start for k in kinds for j in range(len(LABELERS))}
    likely: dict[tuple, float] = {}
    for _ in range(rounds):
        for p, _n in patterns:
            yes, no = share[p[0]], 1 - share[p[0]]
            for j, v in enumerate(p[1:]):
                if v:
                    a = right[p[0], j]
                    yes, no = yes * (a if v > 0 else 1 - a), no * (1 - a if v > 0 else a)
            likely[p] = yes / (yes + no)
        for k in kinds:
            own = [(p, c) for p, c in patterns if p[0] == k]
            share[k] = (sum(c * likely[p] for p, c in own) + 1) / (sum(c for _, c in own) + 2)
            for j in range(len(LABELERS)):
                good = sum(c * (likely[p] if p[1 + j] > 0 else 1 - likely[p]) for p, c in own if p[1 + j])
                voted = sum(c for p, c in own if p[1 + j])
                right[k, j] = min(0.99, max(0.55, (good + weight * start) / (voted + weight)))
    return likely


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, candidates of every row; most texts have no character that any pattern needs."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    chosen = docs.select(named(id_col).cast("long").alias("doc_id"), text.alias("text"))
    may = F.col("text").rlike(MAY_HOLD)
    base, candidates = base_spans(F.col("text")), candidate_spans(F.col("text"))
    return chosen.select("doc_id", F.when(may, base).alias("base"), F.when(may, candidates).alias("candidates"))


def classifier(scanned: DataFrame) -> dict[tuple[str, str, str], float]:
    """Log odds of (kind, feature, value), learned from the labelers' likelihoods."""
    spark = scanned.sparkSession
    spans = scanned.filter(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select("c.*")
    counted = spans.groupBy("kind", *LABELERS).count().collect()  # at most the number of vote patterns
    if not counted:
        return {}
    likely = fit_labelers([((r["kind"], *(r[v] for v in LABELERS)), r["count"]) for r in counted])
    soft = spark.createDataFrame([(*p, float(q)) for p, q in sorted(likely.items())], ["kind", *LABELERS, "likely"])
    judged = spans.join(F.broadcast(soft), ["kind", *LABELERS])  # one row for each vote pattern
    features = F.array(F.struct(F.lit("votes").alias("name"), F.concat_ws("/", *LABELERS).alias("value")), *(F.struct(F.lit(f).alias("name"), F.col(f).alias("value")) for f in FEATURES))
    sums = judged.select("kind", "likely", F.explode(features).alias("f")).groupBy("kind", "f.name", "f.value").agg(F.sum("likely").alias("yes"), F.sum(1 - F.col("likely")).alias("no"))
    totals = {r["kind"]: (r["yes"], r["no"]) for r in judged.groupBy("kind").agg(F.sum("likely").alias("yes"), F.sum(1 - F.col("likely")).alias("no")).collect()}
    out = {(k, "prior", ""): math.log((y + 1) / (n + 1)) for k, (y, n) in totals.items()}
    for r in sums.collect():  # at most FORMS, the vote patterns and a few classes for each kind
        y, n = totals[r["kind"]]
        p = (y + 1) / (y + n + 2)
        out[r["kind"], r["name"], r["value"]] = math.log((r["yes"] + 2 * p) / (r["no"] + 2 * (1 - p))) - math.log(p / (1 - p))
    return out


def with_spans(scanned: DataFrame, weights: dict[tuple[str, str, str], float]) -> DataFrame:
    """Adds ``spans``: base spans and accepted candidates, by kind as listed and by start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    base = F.coalesce("base", none)
    if weights:
        table = F.create_map(*(F.lit(x) for key, w in sorted(weights.items()) for x in ("\t".join(key), w)))
        weigh = lambda c, name, value: F.coalesce(F.try_element_at(table, F.concat_ws("\t", c["kind"], F.lit(name), value)), F.lit(0.0))

        def accepted(c: Column) -> Column:
            votes = F.concat_ws("/", *(c[v] for v in LABELERS))
            total = weigh(c, "prior", F.lit("")) + weigh(c, "votes", votes)
            for f in FEATURES:
                total = total + weigh(c, f, c[f])
            free = ~F.exists(base, lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
            return (total > 0) & free

        added = F.transform(F.filter(F.coalesce("candidates", F.array()), accepted), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    else:
        added = none
    order = lambda s: F.array_position(F.lit(list(KINDS)), s["kind"]).cast("int")
    keyed = F.transform(F.concat(base, added), lambda s: F.struct(order(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return scanned.withColumn("base", base).withColumn("spans", F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, base, spans of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    scanned = scratch.save(scan(docs, id_col, text_col), "spans")
    return with_spans(scanned, classifier(scanned)).select("doc_id", "base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their hash, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with every span (overlaps joined) replaced by its kind in angle brackets."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def add(so_far: Column, s: Column) -> Column:
        seen = F.substring(text, so_far["at"] + 1, F.greatest(s["start"] - so_far["at"], F.lit(0)))
        tag = F.when(s["start"] >= so_far["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), F.concat(so_far["out"], seen, tag).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda x: x)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, with every span in the text replaced.

    Spans are found again where the text is, rather than joined to it, so that
    texts aren't shuffled.
    """
    scratch = scratch or Scratch(docs.sparkSession, "masking")
    weights = classifier(scratch.save(scan(docs, id_col, text_col), "spans"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), named(text_col).cast("string").alias("text"))
    may = F.col("text").rlike(MAY_HOLD)
    looked = whole.select("row", "text", F.when(may, base_spans(F.col("text"))).alias("base"), F.when(may, candidate_spans(F.col("text"))).alias("candidates"))
    found = with_spans(looked, weights)
    return found.select(*(mask(F.col("text"), F.col("spans")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
