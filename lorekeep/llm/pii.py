"""Personal data: exact base patterns, and more identifiers found by bootstrapped contextual extraction."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds: credentials.
MORE_KINDS = ("secret",)
#: A pattern needs this many different trusted identifiers, and this confidence, before it may discover anything; an
#: instance is trusted at MIN_SCORE.
MIN_SEEDS, MIN_CONFIDENCE, MIN_SCORE = 5, 0.8, 0.8
#: What an instance that is neither trusted nor rejected yet counts against its patterns, of a reject's 1.
DOUBT = 0.25
ROUNDS = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: What else may be an identifier: digit groups, and addresses written out with "at" and "dot".
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{1,63}+)+", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Za-z])[0-9]{1,3}+(?:[.\-_ ]|\[\.\])[0-9]{1,3}+(?:[.\-_ ]|\[\.\])[0-9]{1,3}+(?:[.\-_ ]|\[\.\])[0-9]{1,3}+(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[ ./_-]?[0-9]{4}){2}[ ./_-]?[0-9]{1,7}+(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?(?:[ ./-]\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z])")),
)
_HINT = re.compile(r"[0-9]{2}|[\[({] ?[aA][tT] ?[\])}]")
#: Formats by which issuers mark their keys: what they match is a seed, and found, wherever it stands.
_ISSUED = (
    ("AKIA", re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("ASIA", re.compile(r"(?<![A-Za-z0-9])ASIA[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("AIza", re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")),
    ("xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+")),
    ("gh", re.compile(r"(?<![A-Za-z0-9])gh[oprsu]_[A-Za-z0-9]{36,}+")),
    ("_live_", re.compile(r"(?<![A-Za-z0-9])[rs]k_live_[A-Za-z0-9]{16,}+")),
    ("eyJ", re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
)
#: An opaque string given to one of these names is a seed; under any other name it takes a confident pattern.
_NAMES = re.compile(r"(?:^|[^a-z])(?:pass(?:word|wd|phrase)?|pwd|token|secret|credentials?|api_?key|(?:access|private|secret)_?key)$", re.I)
_ASSIGNED = re.compile(r"([A-Za-z_][\w.-]{0,39})([\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?)$")
_VALUE = re.compile(r"[A-Za-z0-9+/_.~!@#$%^&*-]{6,256}+={0,2}")
_LINK = re.compile(r"[=:][ \t]{0,2}[\"']?(?=[A-Za-z0-9+/_.~!@#$%^&*-]{6})")
_BEFORE = re.compile(r"([^\W\d_]*)([^\w\n]*)$")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four base patterns, by kind as in KINDS, then start.

    Each kind is scanned leftmost and without overlaps; what a check rejects is dropped and the scan goes on behind it.
    An address is found from its "@": the run of local characters before it, no further back than the last address, is
    what a leftmost greedy match takes, at linear cost however long the runs are.
    """
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
            at = text.find("@", end)
        else:
            end = max(end, at + 1)  # nothing starts before a failed "@" and passes it
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m is None:
            at = text.find("+", at + 1)
            continue
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
        at = text.find("+", m.end())
    return out


def _context(text: str, start: int, end: int) -> str:
    """The lexical pattern of a slot: the word before it (at most 24 letters) with what stands between, and the mark after it."""
    m = _BEFORE.search(text, max(0, start - 40), start)
    return f"{m[1].lower()[-24:]}{m[2][-4:]}_{text[end : end + 1].strip()[:1]}"


def _opaque(value: str) -> bool:
    """Whether letters and digits alternate as in no word, number or date: at least four changes between them in 12 characters or more."""
    kinds = [c.isdigit() for c in value if c.isalnum()]
    return len(kinds) >= 12 and sum(a != b for a, b in zip(kinds, kinds[1:])) >= 4


def secret_spans(text: str) -> list[tuple[float, bool, int, int, str]]:
    """(score, decided, start, end, pattern) of what may be a credential: issued formats, and values given to a name by "=" or ":".

    Issued formats and opaque values of a credential's name are seeds (1, decided); plain words and numbers are
    rejects (0, decided); other values are left open.
    """
    out: list[tuple[float, bool, int, int, str]] = []
    for mark, pattern in _ISSUED:
        if mark in text:
            out += [(1.0, True, *m.span(), _context(text, *m.span())) for m in pattern.finditer(text)]
    taken = [(s, e) for _, _, s, e, _ in out]
    if "=" in text or ":" in text:
        for m in _LINK.finditer(text):
            name, value = _ASSIGNED.search(text, max(0, m.start() - 43), m.end()), _VALUE.match(text, m.end())
            if name is None or value is None or any(s < value.end() and value.start() < e for s, e in taken):
                continue
            word = value[0].rstrip(".!")
            pattern = f"{name[1].lower()[-24:]}{name[2]}_{text[value.end() : value.end() + 1].strip()[:1]}"
            span = (value.start(), value.start() + len(word), pattern)
            if _opaque(word):
                seed = bool(_NAMES.search(name[1]))
                out.append((float(seed), seed, *span))
            else:
                plain = word.isalpha() and (word.islower() or word.istitle()) or not any(c.isalpha() for c in word)
                out.append((0.0, plain, *span))
    return out


def _fails(kind: str, value: str) -> bool:
    """Whether a candidate is no identifier of its kind by what the kind's own check says."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == "card":
        return not _luhn(digits)
    return kind == "ip" and any(int(p) > 255 for p in _NOT_DIGIT.split(value) if p)


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates: loose shapes that don't touch a base span or an earlier candidate."""
    if not _HINT.search(text):
        return []
    out: list[tuple[str, int, int]] = []
    busy: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if busy and s <= busy[-1][1]:
            busy[-1] = (busy[-1][0], max(e, busy[-1][1]))
        else:
            busy.append((s, e))
    for kind, pattern in _LOOSE:
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind != "email" and not 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 19 and kind != "ip":
                continue
            at = bisect_left(busy, (e, 0))  # busy spans don't overlap, so only the last one before `e` can reach over `s`
            if not at or busy[at - 1][1] <= s:
                out.append((kind, s, e))
                insort(busy, (s, e))
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def row(kind, start, end, pattern, text, score, decided):
        return {"kind": kind, "start": start, "end": end, "pattern": pattern, "instance": text[start:end], "score": score, "decided": decided}

    for batch in batches:
        base, loose = [], []
        for text in batch["text"]:
            text = text or ""
            spans = base_spans(text)
            base.append([row(k, s, e, _context(text, s, e), text, 1.0, True) for k, s, e in spans])
            secrets = [x for x in secret_spans(text) if not any(s < x[3] and x[2] < e for _, s, e in spans)]
            taken = [*spans, *[("secret", s, e) for _, _, s, e, _ in secrets]]
            open_ones = [row(k, s, e, _context(text, s, e), text, 0.0, _fails(k, text[s:e])) for k, s, e in loose_spans(text, taken)]
            loose.append(open_ones + [row("secret", s, e, p, text, score, decided) for score, decided, s, e, p in secrets])
        yield pd.DataFrame({"doc_id": batch["doc_id"], "base": base, "loose": loose})


_SPAN = "array<struct<kind:string,start:int,end:int,pattern:string,instance:string,score:double,decided:boolean>>"


def _score(found: DataFrame) -> DataFrame:
    """Patterns and instances score each other: the (kind, pattern, instance) that end up trusted.

    Seeds (base identifiers, issued keys, opaque values of a credential's name) count 1 and rejects 0 for good; all
    other instances start at 0 and are open.  Each round, a pattern is admitted once the scores of its different instances
    add up to MIN_SEEDS, and its confidence is that sum over itself plus its rejects, plus DOUBT for what its open
    instances lack, plus one; an open instance scores 1 - prod(1 - confidence) over its admitted and confident patterns.  So
    instances found in one round help to admit patterns in the next.  Both sides are aggregates over distinct (pattern,
    instance) pairs, so a frequent pattern is combined before the shuffle.
    """
    spans = found.select(F.explode(F.concat("base", "loose")).alias("x"))
    links = spans.select("x.kind", "x.pattern", "x.instance", "x.score", "x.decided").where("pattern <> '_' or score = 1")
    links = materialise(links.groupBy("kind", "pattern", "instance").agg(F.max("score").alias("score"), F.bool_or("decided").alias("decided")), "pii-links")
    scores = links.groupBy("kind", "instance").agg(F.max("score").alias("score"), F.bool_or("decided").alias("decided"))
    scores = materialise(scores, "pii-scores")
    pairs = links.select("kind", "pattern", "instance")
    confident = None
    for _ in range(ROUNDS):
        rated = pairs.join(scores, ["kind", "instance"])
        against = F.sum(F.when(F.col("score") >= 1, 0.0).when(F.col("decided"), 1.0).otherwise(DOUBT * (1 - F.col("score"))))
        rated = rated.groupBy("kind", "pattern").agg(F.sum("score").alias("s"), against.alias("against"))
        confident = rated.where(f"s >= {MIN_SEEDS}").withColumn("confidence", F.col("s") / (F.col("s") + F.col("against") + 1)).where(f"confidence >= {MIN_CONFIDENCE}")
        confident = materialise(confident.select("kind", "pattern", "confidence"), "pii-patterns")
        now = pairs.join(confident, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.ln(1 - F.least("confidence", F.lit(0.999)))))).alias("now"))
        scores = materialise(
            scores.join(now, ["kind", "instance"], "left").select(
                "kind", "instance", F.when(F.col("decided"), F.col("score")).otherwise(F.coalesce("now", F.lit(0.0))).alias("score"), "decided"
            ),
            "pii-scores",
        )
    trusted = scores.where(f"score >= {MIN_SCORE}").select("kind", "instance", "decided")
    # an open instance is found where a confident pattern stands around it; a seed of a kind that has no base pattern, anywhere
    by_pattern = pairs.join(trusted, ["kind", "instance"]).join(confident, ["kind", "pattern"], "left")
    return materialise(by_pattern.where(F.col("confidence").isNotNull() | F.col("decided")).select("kind", "pattern", "instance"), "pii-trusted")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and more, arrays of (kind, start, end), code points, end exclusive.

    One scan of whole texts yields base spans and looser candidates with their contexts.  The candidates that
    bootstrapping trusts (see `_score`) join back by (kind, pattern, instance); no text is read twice or shuffled.
    `more` holds kinds of base spans that no base pattern matches, and credentials (`secret`).
    Null text counts as empty; very long texts are scanned whole in linear time; repeated rows get equal results, and count
    as one instance; ties don't arise, as spans of a kind never overlap; a null id is kept; an empty table gives an empty
    result; other columns are never read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))  # ids pass pandas as strings: exact, nulls too
    found = texts.mapInPandas(_scan, f"doc_id string, base {_SPAN}, loose {_SPAN}").withColumn("doc_id", F.col("doc_id").cast(kind))
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")  # fixed once written
    trusted = _score(found)
    more = (
        found.select("row", F.explode("loose").alias("x"))
        .select("row", "x.*")
        .join(trusted, ["kind", "pattern", "instance"])
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))  # as many as one text holds
    )
    bare = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select("row", "doc_id", bare.alias("base")).join(more, "row", "left").select(
        "doc_id", "base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("more")
    )


def span_list(spans):
    """kind:start:end by kind as in KINDS and MORE_KINDS, then start, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate((*KINDS, *MORE_KINDS)) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(rank[x["kind"]].alias("r"), x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every base span replaced by its kind in brackets; all columns of any name kept.

    Null text stays null and empty text empty; very long texts are scanned whole; of spans that overlap the earlier counts, of
    those with one start the longer; repeated rows get equal results; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, end = [], 0
            for k, s, e in sorted(base_spans(text), key=lambda x: (x[1], -x[2])):
                if s >= end:
                    out += [text[end:s], f"[{k}]"]
                    end = e
            return "".join([*out, text[end:]])

        return texts.map(one)

    return docs.withColumn(text_col, clean(F.col(text_col)))
