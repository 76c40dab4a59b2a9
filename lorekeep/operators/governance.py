"""Security and governance: risk scans, PII, retention, erasure, audit chain."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.udf import arrow_udf

HIGH_RISK = (
    r"ignore (all |any )?(previous|prior|above) (instructions|prompts|rules)",
    r"disregard (all |any )?(previous|prior|above|your) (instructions|rules|guidelines)",
    r"forget (everything|all) (you|above|before)",
    r"you are now (in )?(developer|admin|root|jailbreak)",
    r"reveal (your|the) (system prompt|hidden instructions)",
    r"override (your|the|all) (safety|security|rules)",
    r"act as (an )?unrestricted",
)
MEDIUM_RISK = (r"pretend (to be|you are)", r"system prompt", r"do not tell (anyone|the user)", r"new instructions:")
BENIGN = r"(never|don't|do not|must not|should not) ignore"


def injection_risk(text: Column) -> Column:
    """high, medium or none.  Advice against ignoring instructions is no attack, but clears that rule only, and only where it stands."""
    low = F.lower(text)
    high = F.regexp_replace(low, BENIGN, " ").rlike(HIGH_RISK[0])
    for p in HIGH_RISK[1:]:
        high = high | low.rlike(p)
    medium = F.lit(False)
    for p in MEDIUM_RISK:
        medium = medium | low.rlike(p)
    return F.when(high, "high").when(medium, "medium").otherwise("none")


def _iban_ok(found: str) -> bool:
    """Mod-97 check: country and check digits moved to the end, letters read as 10 to 35."""
    plain = "".join(found.split()).upper()
    turned = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _luhn_ok(s: str) -> bool:
    digits = [int(c) for c in s if c.isdigit()]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits))) % 10 == 0


def _ssn_ok(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ip_ok(s: str) -> bool:
    return all(int(p) <= 255 for p in s.split("."))


#: Detectors in order of precedence; a span taken by one isn't looked at by the next.
DETECTORS = (
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", None),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b", None),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", None),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}", None),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", None),
    ("bearer", r"\bBearer [A-Za-z0-9._-]{20,}", None),
    ("secret", r"(?i)\b(?:pa[s\u017f][s\u017f]word|pa[s\u017f][s\u017f]wd|[s\u017f]ecret|to[k\u212a]en|api[_-]?[k\u212a]ey)[\t\n\f\r ]*[:=][\t\n\f\r ]*[\"']?[^\t\n\f\r \"']{6,}", None),
    ("email", r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", None),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban_ok),
    ("card", r"\b\d(?:[ -]?\d){12,18}\b", _luhn_ok),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", _ssn_ok),
    ("ipv4", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", _ip_ok),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", None),
    ("mac", r"\b(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b", None),
    ("phone", r"\+\d[\d ().-]{7,18}\d|\(\d{3}\) ?\d{3}-\d{4}|\b\d{3}-\d{3}-\d{4}\b", None),
    ("passport", r"(?i)\bpassport(?: no\.?| number)?:? ?[A-Z]{1,2}\d{6,8}\b", None),
    ("btc", r"\b(?:bc1[a-z0-9]{25,60}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", None),
    ("coordinates", r"-?\d{1,2}\.\d{4,}, ?-?\d{1,3}\.\d{4,}", None),
    ("birth_date", r"(?i)\b(?:born on|date of birth:?|dob:?) ?\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}", None),
)
# word bounds and digits are ASCII, so that an accented letter beside a number or an address doesn't hide it
_COMPILED = tuple((k, re.compile(p, re.ASCII), ok) for k, p, ok in DETECTORS)


def scan_text(text: str | None) -> list[tuple[str, int, int, str]]:
    taken: list[tuple[int, int]] = []
    out = []
    for kind, pattern, ok in _COMPILED:
        for m in pattern.finditer(text or ""):
            if (ok is None or ok(m[0])) and not any(a < m.end() and m.start() < b for a, b in taken):
                taken.append(m.span())
                out.append((kind, m.start(), m.end(), m[0]))
    return sorted(out, key=lambda x: x[1])


@arrow_udf("array<struct<kind:string,start:int,end:int,text:string>>")
def pii_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"kind": k, "start": a, "end": b, "text": x} for k, a, b, x in scan_text(t)])


def pii_scan(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, kind, start, end, text of every detected span."""
    return rows.select(id_col, F.explode(pii_spans(text_col)).alias("x")).select(id_col, "x.*")


def detector_hits(rows: DataFrame, kinds: tuple[str, ...], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, kind of every hit of the detectors `kinds`, each looking at whole texts: a span that two of them find counts for both.
    `pii_scan` gives it to the first only."""

    @F.pandas_udf("array<string>")
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        asked = [x for x in _COMPILED if x[0] in kinds]
        for texts in parts:
            yield texts.map(lambda t: [k for k, pattern, ok in asked for m in pattern.finditer(t or "") if ok is None or ok(m[0])])

    return rows.select(id_col, F.explode(hits(text_col)).alias("kind"))


def vault_tokens(spans: DataFrame, key: str) -> DataFrame:
    """Each span's stable token: kind and a keyed hash, the same for equal text wherever it stands."""
    return spans.withColumn("token", F.concat(F.lit("<"), "kind", F.lit(":"), F.substring(F.sha2(F.concat(F.lit(key), F.lower("text")), 256), 1, 12), F.lit(">")))


def redact_with(key: str | None = None):
    """UDF: spans replaced by [kind], or by vault tokens if a key is given."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for kind, a, b, x in scan_text(text):
                label = f"[{kind}]" if key is None else f"<{kind}:{hashlib.sha256((key + x.lower()).encode()).hexdigest()[:12]}>"
                out += [text[at:a], label]
                at = b
            return "".join([*out, text[at:]])

        for texts in parts:
            yield texts.map(one)

    return run


def expire(facts: DataFrame, now: str, days: int) -> DataFrame:
    """Facts recorded before the cutoff and still open are closed at `now` and deactivated."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    old = (F.col("tx_from") < cutoff) & F.col("tx_to").isNull()
    return facts.withColumn("is_active", F.col("is_active") & ~old).withColumn("tx_to", F.when(old, F.lit(now).cast("timestamp")).otherwise(F.col("tx_to")))


def erase(tables: dict[str, DataFrame], user_id: str, keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Every table without the user's rows; tables keyed by facts lose what points to them.

    A table without `user_id`, `src` and `dst`, or `fact_id` needs the name of its column of fact ids in `keys` (by table);
    one that has none of these is refused, since its rows of the user would survive.
    """
    gone = tables["facts"].where(F.col("user_id") == user_id).select("id")
    keys, out = keys or {}, {}
    for name, df in tables.items():
        if name in keys:
            out[name] = df.join(gone.withColumnRenamed("id", keys[name]), keys[name], "left_anti")
        elif "user_id" in df.columns:
            out[name] = df.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))
        elif {"src", "dst"} <= set(df.columns):
            out[name] = df.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        elif "fact_id" in df.columns:
            out[name] = df.join(gone.withColumnRenamed("id", "fact_id"), "fact_id", "left_anti")
        else:
            raise ValueError(f"table {name} names neither a user nor facts; give its column of fact ids")
    return out


def promote(facts: DataFrame, ids: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """Facts leave their agent's sandbox: listed, confident and not quarantined ones lose their agent."""
    listed = ids.select("id").distinct().withColumn("__listed", F.lit(True))
    joined = facts.join(listed, "id", "left")
    ok = F.coalesce("__listed", F.lit(False)) & (F.col("confidence") >= least_confidence) & ~F.col("quarantined")
    return joined.withColumn("agent_id", F.when(ok, F.lit(None).cast("string")).otherwise(F.col("agent_id"))).drop("__listed")


_ENTRY = "seq bigint, actor string, action string, resource string, prev_hash string, hash string"


def chain_audit(log: DataFrame, genesis: str = "0" * 64) -> DataFrame:
    """Hash-chained log, a chain per actor, in order of seq.  Hashes depend on their predecessor, so a chain is one task's work,
    but not its memory: rows come sorted and in batches, and only the last hash is carried on.  Chains of different actors run
    apart."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        actor, prev = None, genesis
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.actor != actor:
                    actor, prev = r.actor, genesis
                own = hashlib.sha256("\x1f".join([prev, str(r.seq), r.actor, r.action, r.resource]).encode()).hexdigest()
                rows.append((r.seq, r.actor, r.action, r.resource, prev, own))
                prev = own
            yield pd.DataFrame(rows, columns=["seq", "actor", "action", "resource", "prev_hash", "hash"])

    return log.select("seq", "actor", "action", "resource").repartition("actor").sortWithinPartitions("actor", "seq").mapInPandas(link, _ENTRY)


def broken_links(chained: DataFrame, genesis: str = "0" * 64) -> DataFrame:
    """Entries whose hash or link doesn't fit; checked in parallel, since a link only needs its neighbour."""
    own = F.sha2(F.concat_ws("\x1f", "prev_hash", F.col("seq").cast("string"), "actor", "action", "resource"), 256)
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("actor").orderBy("seq")), F.lit(genesis))
    return chained.withColumn("own", own).withColumn("before", before).where("hash <> own or prev_hash <> before").drop("own", "before")


def replay(log: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """The ordered log within a time window."""
    return log.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).orderBy(ts, "seq")


ROLES = {
    "admin": {"*"},
    "writer": {"add", "search", "get", "update", "delete", "stats"},
    "reader": {"search", "get", "stats"},
    "auditor": {"audit", "verify", "stats"},
}


def authorised(role: str, action: str) -> bool:
    allowed = ROLES.get(role, set())
    return "*" in allowed or action in allowed
