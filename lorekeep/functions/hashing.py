"""Content ids, Merkle trees, attestations and field encryption."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.scratch import materialise

ID_FIELDS = ("user_id", "agent_id", "run_id", "subject", "relation", "value", "valid_from", "valid_to")


def fact_id(fields: tuple[str, ...] = ID_FIELDS) -> Column:
    """First 32 hex digits of SHA-256 over the fields; a null is an empty field, never a missing one."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256), 1, 32)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def merkle_root(leaves: DataFrame, position: str = "position", digest: str = "digest") -> str | None:
    """Root over hex digests in order of position (dense from 0): one aggregate per level, lineage cut every fourth, the last node doubled when odd."""
    level = leaves.select(F.col(position).cast("long").alias("i"), F.col(digest).alias("h"))
    n, step = level.count(), 0
    if not n:
        return None
    while n > 1:
        if step % 4 == 3:  # so that a plan holds few levels
            level = materialise(level, "merkle")
        step += 1
        level = level.groupBy(F.expr("i div 2").alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b")).select("i", F.sha2(F.concat("a", "b"), 256).alias("h"))
        n = (n + 1) // 2
    return level.first()["h"]


def _pair_up(level: list[str]) -> list[str]:
    """The next level; the last node is its own partner when their number is odd."""
    partners = [*level[1::2], level[-1]]
    return [hashlib.sha256(f"{a}{b}".encode()).hexdigest() for a, b in zip(level[::2], partners)]


def merkle_proof(digests: list[str], index: int) -> list[tuple[str, str]]:
    """(side, sibling) from the leaf up, over a driver-side list of leaves."""
    proof, level = [], list(digests)
    while len(level) > 1:
        partner = index + 1 if index % 2 == 0 else index - 1
        proof.append(("left" if partner < index else "right", level[min(partner, len(level) - 1)]))
        level, index = _pair_up(level), index // 2
    return proof


def merkle_verify(leaf: str, proof: list[tuple[str, str]], root: str) -> bool:
    for side, sibling in proof:
        leaf = hashlib.sha256((sibling + leaf if side == "left" else leaf + sibling).encode()).hexdigest()
    return leaf == root


def attest(message: str, key: bytes) -> str:
    return hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


def verify_attest(message: str, key: bytes, tag: str) -> bool:
    return hmac.compare_digest(attest(message, key), tag)


def encrypt_field(column: str, key: Column) -> Column:
    return F.base64(F.aes_encrypt(F.col(column), key, F.lit("GCM")))


def decrypt_field(column: str, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(F.col(column)), key, F.lit("GCM")).cast("string")
