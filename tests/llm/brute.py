"""Plain single-machine versions of the corpus operators, for comparison."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

SPACE_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def spark_hash(*values) -> int:
    """Spark's xxhash64 of strings and longs, None leaving the seed as it is; signed."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def simhash(text: str | None, shingle: int = 3) -> int:
    words = SPACE_WORDS.findall((text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items: list, linked) -> list[int]:
    """Index of the smallest item of each item's class under a pair predicate."""
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


def chunk_list(text: str, roll: int, divisor: int, long_words: int) -> list[tuple[int, int, int, str]]:
    """(start, lines, words, text) of the content-defined chunks."""
    lines = text.split("\n")
    hashes = [spark_hash(x) for x in lines]
    words = [len(SPACE_WORDS.findall(x.encode())) for x in lines]
    cuts = [0]
    for i in range(1, len(lines)):
        rolling = spark_hash(*[hashes[i - k] if i - k >= 0 else None for k in range(roll, 0, -1)])
        if words[i - 1] >= long_words or words[i] >= long_words or rolling % divisor == 0:
            cuts.append(i)
    return [(a, b - a, sum(words[a:b]), "\n".join(lines[a:b])) for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True)]


def line_dedup(rows: list[tuple], roll: int, divisor: int, long_words: int, run_words: int, chunk_words: int, seed_words: int, shift_words: int) -> list[str | None]:
    """Text of every (doc_id, text) row after the removal of repeated chunks and passages."""
    order = lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]))
    seeds, lines, first = {}, {}, {}
    for r in sorted({r for r in rows if r[1] is not None}, key=order):
        lines[r] = r[1].split("\n")
        words = [len(SPACE_WORDS.findall(x.encode())) for x in lines[r]]
        chunks = [(a, n, w, body) for a, n, w, body in chunk_list(r[1], roll, divisor, long_words)]
        seeds[r] = chunks + [(i, 1, w, x) for i, (w, x) in enumerate(zip(words, lines[r], strict=True)) if w >= seed_words], len(chunks), words
        for start, n, _, body in sorted(seeds[r][0]):
            first.setdefault((n, body), (r, start))
    gone = {r: set() for r in lines}
    for r, (own, n_chunks, words) in seeds.items():
        chunks = own[:n_chunks]
        later = [first[x[1], x[3]] != (r, x[0]) for x in own]
        i = 0
        while i < n_chunks:
            j = i
            while j < n_chunks and later[j]:
                j += 1
            total = sum(x[2] for x in chunks[i:j])
            for start, n, w, _ in (chunks[k] for k in range(i, j)):
                if total > run_words or n > 1 and w >= chunk_words:
                    gone[r] |= set(range(start, start + n))
            i = max(j, i + 1)
        shifts, last = Counter(), {}
        # a seed that is a chunk of one line as well counts twice, like its rows
        for start, n, w, body in sorted(x for x, late in zip(own, later, strict=True) if late):
            other, at = first[n, body]
            if (n, body) in last:
                other, at = r, last[n, body]
            shifts[other, at - start] += w
            last[n, body] = start
        for (other, shift), w in shifts.items():
            if w < shift_words or not shift and other == r:
                continue
            equal = [0 <= i + shift < len(lines[other]) and lines[other][i + shift] == x for i, x in enumerate(lines[r])]
            i = 0
            while i < len(equal):
                j = i
                while j < len(equal) and equal[j]:
                    j += 1
                if sum(words[i:j]) > run_words:
                    gone[r] |= set(range(i, j))
                i = max(j, i + 1)
    return [None if r[1] is None else "\n".join(x for i, x in enumerate(lines[r]) if i not in gone[r]) for r in rows]


def repeated_words(words: list[str]) -> int:
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)})


def contaminated(text: str | None, items: list[tuple], window: int = 10):
    """(words, hit words, sorted item ids)."""
    find = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    tests = defaultdict(set)
    for item, body in items:
        if body is None:
            continue
        w = find(body.encode().lower())
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            tests[tuple(w[i : i + k])].update([] if item is None else [str(item)])
    words, hit, found = find((text or "").encode().lower()), set(), set()
    for k in {len(x) for x in tests}:
        for i in range(len(words) - k + 1):
            if (got := tests.get(tuple(words[i : i + k]))) is not None:
                found |= got
                hit.update(range(i, i + k))
    return len(words), len(hit), sorted(found)


def shingle_sets(texts):
    out = []
    for text in texts:
        words = SPACE_WORDS.findall((text or "").encode().lower())
        out.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def jaccard_links(sets):
    """All pairs of places whose sets are similar, by counting shared shingles."""
    holders, links = defaultdict(list), []
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        links += [(j, i) for j, m in shared.items() if m / (len(s) + len(sets[j]) - m) >= 0.8]
    return links


def distinct_ids(rows):
    """Ids of the first document of each class of similar texts."""
    rows = sorted((i, t or "") for i, t in rows)
    sets = shingle_sets([t for _, t in rows])
    links = set(jaccard_links(sets))
    wordless = [i for i, s in enumerate(sets) if not s]
    links |= {(wordless[0], i) for i in wordless[1:]}
    found = classes(list(range(len(rows))), lambda a, b: (min(a, b), max(a, b)) in links)
    return {rows[c][0] for c in found}
