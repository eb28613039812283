"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import pyarrow.parquet as pq

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def table(name, directory="/root/testdata/sf0.001"):
    return pq.read_table(f"{directory}/{name}.parquet").to_pylist()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def base_quality(text):
    text = text or ""
    words = BLANK_WORDS.findall(text)
    lines = [x for x in text.split("\n") if BLANK_WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def shingle_set(text, size=2):
    words = BLANK_WORDS.findall(lower(text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def near_groups(rows, size=2):
    """rows: (doc_id, text), distinct ids."""
    sets = {k: shingle_set(t, size) for k, t in rows}
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if top(a) != top(b) and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted((k, len(sets[k]), top(k), top(k) == k) for k in sets)


def leaks(docs, benchmark):
    """docs: (doc_id, text); benchmark: (item_id, text)."""
    windows = {}
    for item, text in benchmark:
        words = tuple(PLAIN_WORDS.findall(lower(text or "")))
        span = min(10, len(words))
        for i in range(len(words) - span + 1 if span else 0):
            windows.setdefault(words[i : i + span], set()).add(str(item))
    spans, out = {len(w) for w in windows}, []
    for key, text in docs:
        words, hit, items = tuple(PLAIN_WORDS.findall(lower(text or ""))), set(), set()
        for span in spans:
            for i in range(len(words) - span + 1):
                if (found := windows.get(words[i : i + span])) is not None:
                    hit |= set(range(i, i + span))
                    items |= found
        out.append((key, len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return sorted(out)


def repeats(rows, span=200):
    """rows: (doc_id, text): bytes covered by a string of ``span`` bytes that starts anywhere else too."""
    seen = Counter()
    texts = [(k, (t or "").encode()) for k, t in rows]
    for _, b in texts:
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for key, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((key, len(b), sum(gone), runs, sha(kept)))
    return sorted(out)
