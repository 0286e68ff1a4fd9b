"""Masking, validation, sanitising and encryption as Columns."""

from __future__ import annotations

import hashlib
import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a document's path must look like, and what it must not have.
SAFE_PATH = r"^[a-zA-Z0-9\-_/ .()]+\.(md|markdown)$"
FORBIDDEN = ((r"\.\.", "parent folder"), ("~/", "home folder"), ("^/", "absolute path"), (r"(?i)<script", "script tag"), ("(?i)javascript:", "script url"), ("(?i)data:", "data url"))
MALICIOUS = (r"(?i)<script[^>]*>", "(?i)javascript:", r"(?i)on(click|error|load)\s*=", "(?i)data:text/html")
PII = ("email", "phone", "ssn", "ip_address", "name", "address", "user_agent")
LONGEST_PATH, LARGEST = 255, 10 * 1024 * 1024


def mask(text: Column, show_last: int = 4) -> Column:
    """Stars for all but the last characters; all stars if there are no more than those."""
    n = F.length(text)
    return F.when(n <= show_last, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - show_last), F.right(text, F.lit(show_last)) if show_last else F.lit("")))


def anonymous_ip(ip: Column) -> Column:
    """IPv4 without its last octet, IPv6 with its first four groups (without leading zeros); anonymous if it is neither."""
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    groups = F.split(ip, ":")
    head = F.split(F.regexp_extract(ip, "^(.*?)::", 1), ":")
    tail = F.split(F.regexp_extract(ip, "::(.*)$", 1), ":")
    size = lambda a: F.size(F.filter(a, lambda x: x != ""))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - size(head) - size(tail), F.lit(0)))
    full = F.when(F.contains(ip, F.lit("::")), F.concat(F.filter(head, lambda x: x != ""), gap, F.filter(tail, lambda x: x != ""))).otherwise(groups)
    plain = F.transform(F.slice(full, 1, 4), lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", "")))
    valid6 = ip.rlike("^[0-9A-Fa-f:]+$") & F.contains(ip, F.lit(":")) & (F.size(full) == 8)
    return F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.regexp_replace(ip, r"\.\d+$", ".0")).when(valid6, F.concat(F.array_join(plain, ":"), F.lit("::"))).otherwise("anonymous")


def path_fault(path: Column) -> Column:
    """Why a path is refused, else null."""
    out = F.when(~path.rlike(SAFE_PATH), "not an allowed name")
    for pattern, why in reversed(FORBIDDEN):
        out = F.when(path.rlike(pattern), why).otherwise(out)
    out = F.when(path.contains("\x00"), "null byte").otherwise(out)
    return F.when(path.isNull() | (path == ""), "empty").when(F.length(path) > LONGEST_PATH, "too long").otherwise(out)


def content_fault(text: Column) -> Column:
    """Why a content is refused, else null."""
    out = F.lit(None).cast("string")
    for pattern in reversed(MALICIOUS):
        out = F.when(text.rlike(pattern), "malicious pattern").otherwise(out)
    return F.when(F.octet_length(text) > LARGEST, "too large").otherwise(out)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"<[^>]*>", "")


def safe_filename(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9\-_.]", "_"), "_{2,}", "_"), 1, 255)


def safe_query(query: Column) -> Column:
    return F.trim(F.substring(F.regexp_replace(query, "[<>]", ""), 1, 1000))


def pii_fields(*present: str) -> Column:
    """The names of those columns that are personal and not null."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in present if c in PII)))


def derive_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    """PBKDF2 with SHA-256, 32 bytes; on the driver."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypt(text: Column, key: bytes) -> Column:
    """AES-256-GCM: binary of nonce, text and tag."""
    return F.aes_encrypt(text, F.lit(key), F.lit("GCM"))


def decrypt(data: Column, key: bytes) -> Column:
    """The text; null if it was changed or the key is another."""
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM")).cast("string")


def in_network(ip: str, network: str) -> bool:
    return ipaddress.ip_address(ip) in ipaddress.ip_network(network)
