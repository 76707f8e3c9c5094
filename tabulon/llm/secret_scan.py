"""Find secrets in text: fixed patterns, and literals that reach a name that says secret.

Assignments are read as source code and configuration files write them (``assignments``). A name
that was given literals before stands for them (constant propagation), so a key that passes
through harmless constants is found where the literal stands. A literal is reported when the
sensitivity of the target's name times how much the literal looks like a secret is high enough.
"""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.assignments import weighted_literals
from tabulon.llm.shared import small_batches, text_of

Span = tuple[int, int, str]


def _either(word: str) -> str:
    """The word with letters A-Z in either case, and no other letter that folds to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
LEAST_VALUE = 6

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# How strongly a word, or two words in a row, of a name say that it holds a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "auth": 0.6, "bearer": 0.8, "signature": 0.5,
    "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0, "encryption key": 1.0,
    "signing key": 1.0, "account key": 0.9, "connection string": 0.8,
}
# Literals that stand in for a secret.
PLACEHOLDERS = {"changeme", "password", "example", "placeholder", "undefined", "required", "optional", "xxxxxxxx", "redacted"}
LEAST_SCORE = 0.45
LEAST_LITERAL = 6
# What a name that says secret has somewhere in it.
_ROOTS = sorted({key.split(" ")[-1] for key in SENSITIVE})


@lru_cache(65_536)
def name_weight(name: str) -> float:
    """Sensitivity of a target name, from its words (snake, kebab, dotted or camel case), in the plural too."""
    words = [w.lower() for w in _WORDS.findall(name)]
    words = [w[:-1] if w.endswith("s") and w not in SENSITIVE and w[:-1] in _ROOTS else w for w in words]
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *pairs]), default=0.0)


def literal_weight(text: str) -> float:
    """How much a literal looks like a secret: entropy per character and kinds of characters, 0 to 1."""
    if len(text) < LEAST_LITERAL or " " in text or text.lower() in PLACEHOLDERS or text[:2] in ("${", "{{", "<%") or text[0] in "<$%":
        return 0.0
    n = len(text)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    kinds = sum(any(map(f, text)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.25 * min(entropy, 4.0) * (0.55 + 0.15 * kinds))


def lexed_literals(text: str) -> list[Span]:
    """Spans of literals, without their quotes, that reach a sensitive name. Later code may use earlier names."""
    low = text.lower()
    if not any(root in low for root in _ROOTS):
        return []
    found = weighted_literals(text, name_weight, LEAST_LITERAL)
    return [(a, b, "literal") for a, b, weight in found if weight * literal_weight(text[a:b]) >= LEAST_SCORE]


def base_spans(text: str) -> list[Span]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    spans += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return spans + [(*m.span(), "hex") for m in HEX.finditer(text)]


def _joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in ordered)


_FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts by kind, a digest of the base spans, and all spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; base kinds are
    assign, access and hex, the lexer adds literal. Whole texts of any length are read. Null and
    empty texts have no spans; null or repeated ids are passed on; other columns are not read; an
    empty table gives no rows.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf(_FIELDS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base = base_spans(text)
                literals = lexed_literals(text)
                count = Counter(kind for _, _, kind in base)
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((count["assign"], count["access"], count["hex"], digest, _joined(base + literals), len(literals)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    return docs.select(F.col(id_col), scan(text_of(text_col)).alias("_s")).select(id_col, "_s.*")
