"""Plain Python versions of the training-data operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from wardline.llm import licenses, lines, mixing, packing, quality, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


# -- 1 ------------------------------------------------------------------------
def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts, percent=80):
    """Index of the first member of each row's component (None for empty sets)."""
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) if sets[i] else None for i in range(len(texts))]


def ngram_join(rows):
    """(doc_id, n_shingles, component_id) for (doc_id, text) rows."""
    root = groups([t for _, t in rows])
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(shingle_set(t)), d if r is None else least.get(r)) for (d, t), r in zip(rows, root)]


# -- 2 ------------------------------------------------------------------------
def targets(rows):
    """{source: (size, target)} for (doc_id, source, text) rows."""
    size = Counter()
    for _, s, t in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        open_ones = [s for s in order if s not in capped]
        if not open_ones:
            break
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in open_ones)
        over = {s for s in open_ones if 3 * size[s] <= level * weight[s]}
        if not over:
            break
        capped |= over
    return {s: (size[s], 3.0 * size[s] if s in capped else level * weight[s]) for s in order}


def mix(rows, seed=mixing.SEED):
    """Copies of each (doc_id, source, text) row."""
    plan, copies = targets(rows), [0] * len(rows)
    by_source = defaultdict(list)
    for i, (d, s, t) in enumerate(rows):
        key = hashlib.md5("|".join([seed, "" if d is None else str(d), "" if t is None else hashlib.md5(
            t.encode()).hexdigest()]).encode()).hexdigest()
        by_source[s].append((i, len(words(t)), key))
    for s, docs in by_source.items():
        size, target = plan[s]
        e = min(3.0, target / size) if size else 0.0
        whole, p = math.floor(e), e - math.floor(e)
        need = target - whole * size
        for i, n, _ in docs:
            copies[i] = whole if n else 0
        ranked = []
        for i, n, key in docs:
            u = (int(key[:13], 16) + 0.5) / 2 ** 52
            if n and p > 0:
                ranked.append(((u / (1 - u)) * ((1 - p) / p), key, n, i))
        ranked.sort()
        reached, rest = 0, []
        for at, (ratio, key, n, i) in enumerate(ranked):
            if reached + n > need:
                rest = ranked[at:]
                break
            reached += n
            copies[i] += 1
        still = need - reached
        near = [(abs(n - still), key, i) for _, key, n, i in rest if abs(n - still) < still]
        if near:
            best = min(near)[:2]
            for miss, key, i in near:
                if (miss, key) == best:
                    copies[i] += 1
    return copies


# -- 3 ------------------------------------------------------------------------
def pieces(rows, max_tokens=2048):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    out = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), max_tokens)):
            part = ids[s:s + max_tokens]
            out.append((d, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


# -- 5 ------------------------------------------------------------------------
def base_counts(text):
    text = text or ""
    w = words(text)
    with_word = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(with_word) - len(set(with_word)),
            len(covered))


def char_class(c):
    b = c.encode()[0]
    return int(quality._CLASS[b])


def histograms(text):
    text = text or ""
    classes = [0] * quality.N_CLASSES
    for c in text:
        classes[char_class(c)] += 1
    common = [0] * (len(quality.COMMON_WORDS) + 1)
    for w in words(text.translate(LOWER)):
        common[quality.COMMON_WORDS.index(w) if w in quality.COMMON_WORDS else -1] += 1
    return classes, common


def js(a, b):
    n, m = sum(a), sum(b)
    if not n or not m:
        return 0.0
    total = 0.0
    for x, y in zip(a, b):
        p, q = x / n, y / m
        for z in (p, q):
            if z:
                total += z * math.log2(z / ((p + q) / 2)) / 2
    return math.sqrt(max(total, 0.0))


def quality_references(rows):
    """{lang: (classes, common)} of (lang, classes, common) rows: the half of the votes nearest to it, again and again."""
    votes = defaultdict(set)
    for lang, classes, common in rows:
        if lang is not None and sum(classes) >= quality.MIN_CHARS and sum(common) >= quality.MIN_WORDS:
            votes[lang].add(tuple(tuple(c * quality.VOTE // sum(h) for c in h) for h in (classes, common)))
    refs = {}
    for lang, own in votes.items():
        if len(own) < quality.MIN_VOTERS:
            continue
        near = own
        for _ in range(quality.ROUNDS + 1):
            ref = [[sum(x) for x in zip(*h)] for h in zip(*near)]
            bins = [(int(sum(js(a, b) for a, b in zip(v, ref)) * quality.BINS / 2), v) for v in own]
            near = [v for b, v in bins if 2 * sum(c < b for c, _ in bins) < len(own)]
        refs[lang] = ref
    return refs


def quality_verdicts(rows):
    """(counts, base_failed, kept) for (doc_id, lang, text) rows."""
    own = [histograms(t) for _, _, t in rows]
    refs = quality_references([(lang, *h) for (_, lang, _), h in zip(rows, own)])
    out = []
    for (_, lang, text), (classes, common) in zip(rows, own):
        counts = base_counts(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        pairs = [(js(classes, a), js(common, b)) for a, b in ([refs[lang]] if lang in refs else refs.values())]
        by_class, by_word = min(pairs, key=sum, default=(0, 0))
        off = (sum(classes) >= quality.MIN_CHARS and by_class > quality.MAX_CLASS_DISTANCE) or (
            counts[0] >= quality.MIN_WORDS
            and by_word ** 2 > quality.MAX_WORD_DISTANCE ** 2 + quality.WORD_NOISE / counts[0])
        out.append((counts, failed, not failed and not off))
    return out


# -- 6 ------------------------------------------------------------------------
def repeats(rows, width=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            s = b[i:i + width]
            d_ = math.inf if d is None else d
            least[s] = min(least.get(s, d_), d_)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        d_ = math.inf if d is None else d
        for i in range(len(b) - width + 1):
            if least[b[i:i + width]] < d_:
                gone[i:i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


# -- 7 ------------------------------------------------------------------------
def top_k(rows, k=5, divisor=50):
    ok = [(i, v, [math.floor(256 * x) for x in e]) for i, (v, e) in enumerate(rows)
          if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, e in ok:
        if v is None or v % divisor:
            continue
        scored = sorted((-min(max(sum(a * b for a, b in zip(e, f)), -2 ** 63), 2 ** 63 - 1), math.inf if w is None else w)
                        for j, w, f in ok if j != i)
        out.extend((v, r + 1, None if w == math.inf else w, -s) for r, (s, w) in enumerate(scored[:k]))
    return out


# -- 8 ------------------------------------------------------------------------
def url_verdict(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = m.group(1).translate(LOWER), m.group(2)
    best = None
    for verdict, rule in urls.BASE_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    if best:
        return host, path, *best
    hit = url is not None and any(re.search(p.regex, url.lower()) for p in urls.PATTERNS)
    return host, path, None, "block" if hit else "allow"


# -- 9 ------------------------------------------------------------------------
def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def removed_lines(rows, threshold=lines.THRESHOLD, min_chars=lines.MIN_CHARS):
    """Removed line numbers of each (doc_id, text) row."""
    first = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for place, i in enumerate(order):
        for n, line in enumerate((rows[i][1] or "").split("\n")):
            if words(line):
                first.setdefault(line, (place, n, i))
    by_length = defaultdict(list)
    for line in first:
        if len(line) >= min_chars:
            by_length[len(line)].append(line)
    near = {y for y in first if len(y) >= min_chars for m in range(len(y) - threshold, len(y) + threshold + 1) for x in by_length[m]
            if first[x] < first[y] and x != y and edit_distance(x, y) <= threshold}
    return [[n for n, line in enumerate((t or "").split("\n"))
             if line in first and (line in near or first[line][1:] != (n, i))] for i, (_, t) in enumerate(rows)]


# -- 10 -----------------------------------------------------------------------
def closest(notice, text, lo, hi, errors):
    """(distance, start, end) of the stretch between word ends that is fewest edits away, the first of them."""
    best = None
    for start in range(lo, hi):
        if start and text[start - 1] != " " or text[start] == " ":
            continue
        row = list(range(len(notice) + 1))
        for end in range(start + 1, min(hi, start + len(notice) + errors) + 1):
            new = [end - start]
            for k, c in enumerate(notice, 1):
                new.append(min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (c != text[end - 1])))
            row = new
            if min(row) > errors:
                break
            if (end == len(text) or text[end] == " ") and row[-1] <= errors and (best is None or row[-1] < best[0]):
                best = row[-1], start, end
    return best


def license_row(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(w))
              if w[i:i + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    joined, found = " ".join(w), []
    for notice, label in licenses.NOTICES:
        errors = len(notice) // licenses.LETTERS_PER_ERROR
        pieces = [notice[len(notice) * i // (errors + 1):len(notice) * (i + 1) // (errors + 1)] for i in range(errors + 1)]
        left = [(0, len(joined))] if any(p in joined for p in pieces) else []  # a match keeps one of these
        while left:
            lo, hi = left.pop()
            hit = closest(notice, joined, lo, hi, errors)
            if hit:
                found.append((*hit, label, 1 - hit[0] / len(notice)))
                left += [(lo, hit[1]), (hit[2], hi)]
    kept = [f for f in found if not any(g[0] < f[0] and f[1] < g[2] and g[1] < f[2] for g in found)]
    labels = base | {f[3] for f in kept}
    score = 1.0 if places else max([f[4] for f in kept], default=0.0)
    return (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


# -- 11 -----------------------------------------------------------------------
def phrase_counts(rows, max_words=4):
    """Counter of (lang, phrase) and words of each language for (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def collocations(rows, min_count=30, max_words=4, top=2000):
    f, n = phrase_counts(rows, max_words)
    candidates = {key: a for key, a in f.items() if a >= min_count and " " in key[1]}
    covered = Counter()
    for (lang, phrase), a in candidates.items():
        w = phrase.split(" ")
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = lang, " ".join(w[i:i + k])
                covered[key] = max(covered[key], a)
    out = defaultdict(list)
    for (lang, phrase), a in candidates.items():
        if 100 * covered[lang, phrase] >= 80 * a:
            continue
        w = phrase.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, phrase.encode(), phrase, a, left, right, score))
    return [(lang, i + 1, p, a, left, right, n[lang], score) for lang, found in out.items()
            for i, (_, _, _, p, a, left, right, score) in enumerate(sorted(found)[:top])]


# -- 12 -----------------------------------------------------------------------
def spelling_words(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def variants(n, ratio=2):
    near = defaultdict(list)
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    for w in n:
        near[w] = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_edit(w, x)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out
