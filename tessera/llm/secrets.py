"""Secret scanning: candidates judged by a random forest.

A candidate is a run of at least ``shortest`` letters, digits and ``+/_-.`` that holds a digit, unless ``digitless``
runs are asked for (then every long word is one); the value,
of any length and any characters but spaces, after a naming word and ``=`` or ``:`` (a quoted one up to its quote,
spaces included); and a run that begins with a known prefix.
The forest, written in numpy, sees its length, character transitions, dictionary coverage, whether it
looks like a path, host or number, and the words beside it; it learns from labelled findings which
candidates are false positives.  Findings keep their score, so no candidate is lost.

Defined cases: null and empty texts have no findings; long texts are scanned whole; repeated rows give
their findings each; a null id is carried; an empty table has no findings.
"""

from __future__ import annotations

import dataclasses
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import renamed, table
from tessera.llm.textkernel import buffers, text_groups

SHORTEST = 14
#: Bytes to each side whose words are looked at.
BESIDE = 40
TREES, DEPTH, LEAF = 40, 9, 3
#: Labelled findings a forest is fitted on.
FIT_FINDINGS = 20_000

_RUN = np.zeros(256, dtype=bool)
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "+/_-."]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True

#: Words that name a credential when they stand beside it.
NAMING = {"token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "auth", "bearer", "credential", "private", "access"}
#: Words that mark an example or a public identifier.
HARMLESS = {"example", "sample", "dummy", "placeholder", "commit", "revision", "checksum", "sha1", "sha256", "md5", "uuid", "version", "isbn", "order", "invoice", "phone", "card", "mail"}
#: Words and word parts that ordinary identifiers and paths are made of.
DICTIONARY = {
    "about", "account", "action", "address", "admin", "archive", "array", "article", "attribute", "background", "base", "block", "book", "border", "build", "button", "cache", "chapter",
    "check", "class", "client", "code", "column", "com", "common", "component", "config", "connection", "content", "control", "count", "create", "data", "date", "default", "delete",
    "document", "domain", "download", "element", "error", "event", "example", "export", "feature", "field", "file", "filter", "final", "first", "format", "function", "global", "group", "handler",
    "header", "height", "home", "html", "http", "https", "image", "index", "info", "input", "item", "java", "label", "language", "last", "layout", "length", "level", "library", "list", "local",
    "mail", "main", "manager", "message", "model", "module", "name", "network", "node", "number", "object", "offset", "option", "order", "output", "package", "page", "parameter", "path", "point",
    "position", "price", "process", "product", "project", "property", "public", "python", "query", "report", "request", "resource", "response", "result", "return", "section", "select", "server",
    "service", "session", "simple", "size", "source", "start", "state", "static", "string", "style", "system", "table", "target", "template", "test", "text", "time", "title", "type", "update",
    "user", "value", "version", "view", "width", "window", "word",
}
#: What known kinds of credentials begin with.
PREFIXES = ("AKIA", "ASIA", "sk_live_", "ghp_", "xoxb-")
#: A naming word, alone or as a part of a name, an optional quote, and = or :; then the value.
_HEAD = rb"(?i:" + b"|".join(sorted((w.encode() for w in NAMING), key=len, reverse=True)) + rb")(?![A-Za-z])[A-Za-z0-9_.\-]{0,40}[\"'\]]{0,2}[ \t]{0,8}(?:=>|[=:])(?![=>])[ \t]{0,8}"
_NAMED = re.compile(_HEAD + rb"(?:\"(?P<d>[^\"\r\n]+)\"|'(?P<s>[^'\r\n]+)'|(?P<b>[^\s]+))")
_HEAD = re.compile(_HEAD)
_KNOWN = re.compile(rb"(?<![A-Za-z0-9+/_.\-])(?:" + "|".join(map(re.escape, PREFIXES)).encode() + rb")[A-Za-z0-9+/_.\-]+")
_PARTS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)))
_WORD = re.compile(r"[A-Za-z_0-9]+")


def runs(raw: np.ndarray, at: np.ndarray, shortest: int = SHORTEST, digitless: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, begin, end) of the candidates of consecutive texts, as offsets into ``raw``."""
    lo, hi = int(at[0]), int(at[-1])
    x = raw[lo:hi]
    inside = _RUN[x]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = at[1:-1] - lo
    cut = cut[(cut > 0) & (cut < len(x))]
    begins[cut], ends[cut - 1] = inside[cut], inside[cut - 1]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    digits = np.concatenate([[0], np.cumsum(_DIGIT[x])])
    ok = (e - b >= shortest) & (digitless | (digits[e] > digits[b]))
    b, e = b[ok] + lo, e[ok] + lo
    more = []
    for t in range(len(at) - 1):
        more += [(int(at[t]) + p, int(at[t]) + q) for p, q in _named(raw[at[t] : at[t + 1]].tobytes())]
    if more:
        both = np.unique(np.concatenate([np.stack([b, e], axis=1), np.array(more)]), axis=0)
        b, e = both[:, 0], both[:, 1]
    return np.searchsorted(at, b, side="right") - 1, b, e


def _named(text: bytes) -> Iterator[tuple[int, int]]:
    """(begin, end) of the values after naming words, and of what begins with a known prefix."""
    p = 0
    while m := _NAMED.search(text, p):
        b, p = m.span(m.lastgroup)
        if m.lastgroup != "b":
            yield b, p
            continue
        spans, e = [(b, p)], p
        inner = [x.span() for x in _HEAD.finditer(text, b, e)]  # names inside the value: a=b&token=c
        for k, (head, value) in enumerate(inner):
            if text[value : value + 1] in (b'"', b"'") and head > b:
                p = head  # quoted, so it may go on after a space
                break
            spans.append((value, inner[k + 1][0] if k + 1 < len(inner) else e))
        for b, e in spans:  # what closes around a value is not part of it
            while e > b and text[e - 1] in b",;)]}\"'":
                e -= 1
            while b < e and text[b] in b"\"'":
                b += 1
            if e > b:
                yield b, e
    for m in _KNOWN.finditer(text):
        yield m.span()


NAMES = ["length", "digits", "upper", "lower", "marks", "changes", "vowel_pairs", "repeats", "steps", "distinct", "hex", "dictionary", "path", "host", "number", "assigned", "quoted", "named", "harmless"]


def describe(value: str, before: str, after: str) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "m" for c in value]
    share = {k: kinds.count(k) / n for k in "dulm"}
    pairs = list(zip(value, value[1:], strict=False))
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    vowels = sum((a.lower() in "aeiou") != (b.lower() in "aeiou") for a, b in pairs if a.isalpha() and b.isalpha()) / n
    repeats = sum(a == b for a, b in pairs) / n
    steps = sum(ord(b) - ord(a) == 1 for a, b in pairs) / n
    covered = sum(len(m) for m in _PARTS.findall(value.lower())) / n
    near = [w.lower() for w in _WORD.findall(before)[-4:]] + [w.lower() for w in _WORD.findall(after)[:2]]
    pieces = [w for x in near for w in (x, *x.split("_"))]
    return [
        n, share["d"], share["u"], share["l"], share["m"], changes, vowels, repeats, steps, len(set(value)) / n,
        float(all(c in "0123456789abcdef" for c in value.lower())), covered,
        float(value.count("/") >= 2 or bool(re.search(r"\.(?:py|js|html?|txt|json|xml|csv|png|jpe?g|java|md)$", value))),
        float(bool(re.fullmatch(r"(?:[\w-]+\.)+[A-Za-z]{2,}", value)) or bool(re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", value)) or before.endswith("@")),
        float(bool(re.fullmatch(r"[\d.+-]+", value))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before != ""),
        float(any(w in NAMING for w in pieces)), float(any(w in HARMLESS for w in pieces) or "example" in value.lower()),
    ]


# --- the forest ---------------------------------------------------------------


@dataclasses.dataclass
class Forest:
    feature: np.ndarray  # (trees, nodes); -1 in a leaf
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = f[node] >= 0
                right = x[np.arange(len(x)), np.maximum(f[node], 0)] > t[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += v[node]
        return total / max(1, len(self.feature))


def grow(x: np.ndarray, y: np.ndarray, seed: int = 9) -> Forest:
    rng = np.random.default_rng(seed)
    nodes = (1 << (DEPTH + 1)) - 1
    f, t, v = np.full((TREES, nodes), -1), np.zeros((TREES, nodes)), np.full((TREES, nodes), float(y.mean()) if len(y) else 0.5)
    some = min(x.shape[1], int(np.ceil(np.sqrt(x.shape[1]))) + 1)
    for k in range(TREES if len(y) else 0):
        work = [(0, rng.integers(0, len(y), len(y)), 0)]
        while work:
            node, rows, depth = work.pop()
            v[k, node] = y[rows].mean()
            if depth == DEPTH or len(rows) < 2 * LEAF or v[k, node] in (0.0, 1.0):
                continue
            best = (1e-9, -1, 0.0)
            for j in rng.choice(x.shape[1], some, replace=False):
                order = np.argsort(x[rows, j], kind="stable")
                xs, ys = x[rows[order], j], y[rows[order]]
                n = np.arange(1, len(xs))
                left = np.cumsum(ys)[:-1]
                p, q = left / n, (ys.sum() - left) / (len(xs) - n)
                gain = v[k, node] * (1 - v[k, node]) - (n * p * (1 - p) + (len(xs) - n) * q * (1 - q)) / len(xs)
                gain[(xs[1:] <= xs[:-1]) | (n < LEAF) | (len(xs) - n < LEAF)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], int(j), (xs[i] + xs[i + 1]) / 2)
            if best[1] >= 0:
                f[k, node], t[k, node] = best[1], best[2]
                right = x[rows, best[1]] > best[2]
                work += [(2 * node + 1, rows[~right], depth + 1), (2 * node + 2, rows[right], depth + 1)]
    return Forest(f, t, v)


def labelled_findings(n: int = 3000, seed: int = 9) -> list[tuple[str, str, str, int]]:
    """(value, before, after, secret) findings with labels that are known because they are made here: the default training set."""
    r = random.Random(seed)
    any_ = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: any_("etaoinshrdlu", r.randint(2, 8))
    hexa, b64, caps = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567"
    out = []
    for _ in range(n):
        before, after = " ".join(word() for _ in range(4)) + " ", " " + " ".join(word() for _ in range(3))
        name = r.choice(sorted(NAMING))
        lead = before + r.choice([f"{name}=", f'{name} = "', f"{name}: ", f"{name} "])
        given = before + r.choice([f"{name}=", f'{name} = "', f"{name}: "])
        plain = r.random() < 0.3
        secret = r.random() < 0.5
        if secret:
            kind = r.randrange(7)
            if kind == 0:
                value, before = any_(hexa, r.choice([18, 24, 32, 40, 64])), lead
            elif kind == 1:
                value, before = r.choice(["AKIA", "ASIA"]) + any_(caps, 16), before if plain else lead
            elif kind == 2:
                value, before = any_(b64, r.randint(20, 60)), before if plain else lead
            elif kind == 3:
                value, before = r.choice(["sk_live_", "ghp_", "xoxb-"]) + any_(string.ascii_letters + string.digits, r.randint(16, 36)), before if plain else lead
            elif kind == 4:
                value, before = any_(string.ascii_letters + string.digits + "!@#$%&*", r.randint(8, 16)), given
            elif kind == 5:
                value, before = any_(string.ascii_letters, r.randint(8, 40)), given
            else:
                value, before = r.choice(" -_.").join(word() for _ in range(r.randint(3, 5))), before + f'{name} = "'
        else:
            kind = r.randrange(10)
            if kind == 0:
                value = any_(string.digits, r.choice([14, 16, 16, 18]))
            elif kind == 1:
                value = ".".join(str(r.randrange(100, 256)) for _ in range(4))
            elif kind == 2:
                value, before = ".".join([word() + str(r.randrange(100)), r.choice(["example", word()]), r.choice(["com", "org", "net"])]) + "", before + (word() + "@" if r.random() < 0.7 else "")
            elif kind == 3:
                value, before = any_(hexa, r.choice([32, 40, 64])), before + r.choice(["commit ", "sha256 ", "md5 checksum ", "revision "])
            elif kind == 4:
                value, before = "-".join(any_(hexa, k) for k in (8, 4, 4, 4, 12)), before + r.choice(["uuid ", "", "order "])
            elif kind == 5:
                value = "/".join(r.choice(sorted(DICTIONARY)) for _ in range(3)) + f"/{word()}{r.randrange(9)}." + r.choice(["html", "png", "py"])
            elif kind == 6:
                value = "_".join(r.choice(sorted(DICTIONARY)) for _ in range(3)) + str(r.randrange(100))
            elif kind == 7:
                value, before = r.choice([word(), r.choice(sorted(DICTIONARY)), any_(string.digits, r.randint(1, 6)), "null", "None", "true", "false"]), given
            elif kind == 8:
                value, before = r.choice(["os.environ", "config.get", "get_token()", "self.token", "<token>", "${TOKEN}", "********", "xxxxxxxx", "changeme", "your_password_here"]) + r.choice(["", ";", "."]), given
            else:
                value, before = r.choice(["0123456789abcdef", "xxxxxxxxxxxx1234", "1111111111111111", "EXAMPLEKEY012345", "abcdefghijk12345"]) + any_("0x", r.randint(0, 6)), lead
        out.append((value, before, after, int(secret)))
    return out


def train(findings: list[tuple[str, str, str, int]]) -> Forest:
    x = np.array([describe(v, b, a) for v, b, a, _ in findings], dtype=float).reshape(-1, len(NAMES))
    return grow(x, np.array([y for *_, y in findings], dtype=float))


def train_on(findings: DataFrame, most: int = FIT_FINDINGS) -> Forest:
    """The forest of a table of labelled findings (value, before, after, secret 0/1): at most ``most`` rows, chosen by a hash.

    ``before`` and ``after`` are the texts beside a value; nulls are empty, rows without value or label take no part.
    """
    rows = findings.where("value <> '' AND secret in (0, 1)").select("value", *(F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after")), F.col("secret").cast("int").alias("secret"))
    got = rows.orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after", "secret").limit(most).collect()
    return train([tuple(r) for r in got])


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, digitless: bool = False) -> DataFrame:
    """(id, start, length, value, score): every candidate, positions in bytes of the UTF-8 text.

    ``shortest`` and ``digitless`` say which bare runs are candidates; named values and known prefixes always are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = buffers(batch.column(1))
            for i, j in text_groups(at):
                text, b, e = runs(raw, at[i : j + 1], shortest, digitless)
                if not len(b):
                    continue
                text = text + i
                get = lambda p, q: raw[p:q].tobytes().decode("utf-8", "replace")
                values = [get(p, q) for p, q in zip(b, e, strict=True)]
                rows = [describe(v, get(max(at[t], p - BESIDE), p), get(q, min(at[t + 1], q + BESIDE))) for v, t, p, q in zip(values, text, b, e, strict=True)]
                score = sent.value.predict(np.array(rows, dtype=float))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(b - at[text]), pa.array(e - b), pa.array(values), pa.array(score)], names=["id", "start", "length", "value", "score"])

    return renamed(docs, id=id_col, text=text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, start long, length long, value string, score double")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), train(labelled_findings()))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= 0.5).cast("int").alias("secret"))
