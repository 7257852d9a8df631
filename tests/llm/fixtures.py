"""Small inputs with all that may go wrong, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

DOC = "doc_id long, text string, lang string, source string, n_chars long, h string, words string, _row string"

_PROSE = "the cat sat on a mat and then it went off to see what the old dog had left of its dinner by the open door".split()


def prose(n: int, seed: int = 0) -> str:
    return " ".join(f"{_PROSE[(i * 7 + seed * 3 + i * i % 5) % len(_PROSE)]}{'.' if i % 11 == 10 else ''}{(i * 31 + seed) % 97 if i % 4 else ''}" for i in range(n))


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like internal ones."""
    rows = [
        (1, prose(80), "en", "src0"), (2, prose(80), "en", "src0"), (2, prose(80), "en", "src0"), (3, None, None, None), (4, "", "", ""),
        (5, " \n\t ", "en", "src1"), (None, prose(60, 1), None, "src1"), (None, None, "de", None), (6, prose(81), "en", "src9"),
        (7, "one two", "en", "src1"), (8, "ONE two", "en", "src1"), (9, prose(20_000, 2), "en", "src2"), (10, "word " * 3_000, "en", "src2"),
        (11, "é É \u00a0 \U0001F600 x\x1cy ΑΣ <|im_end|>", "fr", "src3"), (7, prose(70, 5), "en", "src1"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "h", "words", None) for r in rows], DOC)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def split_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality_counts(text: str | None) -> tuple:
    w, text = split_words(text), text or ""
    lines = [x for x in text.split("\n") if split_words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def components(rows: list[tuple]) -> list[tuple]:
    """(id, set size, least id reachable) of (id, text) rows, all pairs held against each other."""
    sets = []
    for _, text in rows:
        w = split_words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    at = list(range(len(rows)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                at[top(i)] = top(j)
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0)  # noqa: E731  null ids come first
    least: dict[int, int] = {}
    for i in range(len(rows)):
        if top(i) not in least or order(i) < order(least[top(i)]):
            least[top(i)] = i
    return [(rows[i][0], len(sets[i]), rows[least[top(i)]][0]) for i in range(len(rows))]


def contamination(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = find(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = find(text), set(), set()
        for size in set(map(len, windows)):
            for i in range(len(w) - size + 1):
                if x := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= x
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def private(text: str | None) -> list[tuple]:
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 14 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 10 <= len(d) <= 15),
    }
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def credentials(text: str | None) -> list[tuple]:
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c + "?" for c in k) for k in ("password", "passwd", "secret", "token", "api_key"))
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
