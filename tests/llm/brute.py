"""Plain Python answers to the contracts, one document at a time."""

import hashlib
import re

PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_ok(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


SECRETS = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
               r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)


def secret_ok(kind, m):
    return len(m.group(2)) >= 8 if kind == "assign" else len(m.group(0)) >= (16 if kind == "access" else 32)


def base_spans(text, kinds, ok):
    found = []
    for rank, (kind, pattern) in enumerate(kinds):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if ok(kind, m)]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def pii_base(text):
    return base_spans(text or "", PII, lambda k, m: pii_ok(k, m.group(0)))


def secret_base(text):
    return base_spans(text or "", SECRETS, secret_ok)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
