"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def spans_of(found):
    order = {k: i for i, k in enumerate(found)}
    flat = sorted((a, order[k], b, k) for k, all_ in found.items() for a, b in all_)
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in flat)


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    best = {n: min(g)[3] for n, g in groups.items()}
    out = []
    for d, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out.append((d, best[n], len(groups[n]), d == best[n], sha(n)))
    return out


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def pii(text):
    text = text or ""
    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    cards = [(m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    found["card"] = [m.span() for m, d in cards if 14 <= len(d) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets(text):
    text = text or ""
    assign = re.finditer(ASSIGN, text, re.A)
    return {
        "assign": [m.span() for m in assign if len(m[2]) >= 6],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    }


MORE_SECRETS = {
    "vendor": r"\b(?:gh[opsu]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\\s]*",
    "login": r"://[^\s/:@]+:[^\s/:@]+@",
}


def owned_secrets(rows, owners=2, repositories=5):
    """(doc_id, spans, n_live, n_example) of rows (doc_id, text, owner): values by who holds them."""
    each = []
    for i, (d, t, owner) in enumerate(rows):
        found = {k: [(a, b, (t or "")[a:b]) for a, b in v] for k, v in secrets(t).items()}
        found["assign"] = [(m.start(), m.end(), m[2]) for m in re.finditer(ASSIGN, t or "", re.A) if len(m[2]) >= 6]
        for k, pattern in MORE_SECRETS.items():
            hits = [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t or "")]
            found[k] = [(a, b, re.sub(r"\s", "", v.split("KEY-----")[-1])) for a, b, v in hits] if k == "pem" else hits
            found[k] = [x for x in found[k] if x[2]]
        each += [(i, d, owner or "", k, a, b, v) for k, all_ in found.items() for a, b, v in all_]
    holders = defaultdict(set)
    for _, d, owner, _, _, _, v in each:
        holders[v].add((owner, d))
    live = {v: len({o for o, _ in h}) <= owners and len(h) <= repositories for v, h in holders.items()}
    out = []
    order = [*secrets(""), *MORE_SECRETS]
    for i, (d, _, _) in enumerate(rows):
        own = [x for x in each if x[0] == i]
        kept = sorted((a, order.index(k), b, k) for _, _, _, k, a, b, v in own if live[v] or k in order[:3])
        n = sum(live[x[6]] for x in own)
        out.append((d, ",".join(f"{k}:{a}:{b}" for a, _, b, k in kept), n, len(own) - n))
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    hits = [(i, label) for i in range(len(words)) for phrase, label in PHRASES.items() if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in hits}))


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url(u):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def repeats(rows, length=200):
    count = Counter(d[i : i + length] for _, t in rows for d in [(t or "").encode()] for i in range(len(d) - length + 1))
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone, last = bytearray(len(data)), 0
        for i in range(len(data) - length + 1):
            if count[data[i : i + length]] > 1:
                first = max(i, last)
                last = i + length
                gone[first:last] = b"\1" * (last - first)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted(((d, len(shingles(t, width)), find(d) if d is not None else None) for d, t in rows), key=repr)


def held_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 3 == 1


def url_templates(rows, z=2.58, min_pages=5, min_hosts=3, min_labelled=5, strength=4.0, threshold=0.5, bands=4):
    """(id, template, verdict) of rows (id, url, label)."""
    pages = []
    for i, u, given in rows:
        host, path, _, ruled = url(u)
        segs = [s for s in path.split("/") if s]
        segs = tuple("*" if re.search(r"^[0-9]+([._-][A-Za-z0-9]+)?$|^[0-9a-fA-F-]{16,}$|[0-9]{4,}", s, re.A) else s for s in segs)
        pages.append((i, host, segs, ruled, ruled or given))
    own = Counter((h, k, s) for _, h, segs, _, _ in pages for k, s in enumerate(segs))
    hosts = Counter((k, s) for _, k, s in own)
    shaped = [tuple(s if own[h, k, s] >= min_pages or hosts[k, s] >= min_hosts else "*" for k, s in enumerate(segs)) for _, h, segs, _, _ in pages]
    branch = defaultdict(lambda: [0, 0])
    for (_, h, _, _, label), segs in zip(pages, shaped, strict=True):
        for k, s in enumerate(segs):
            if label and s != "*":
                branch[h, segs[:k], s][0] += label == "block"
                branch[h, segs[:k], s][1] += 1
    band = {key: min(int(math.asin(math.sqrt(b / m)) / (math.pi / 2 / bands)), bands - 1) for key, (b, m) in branch.items() if m >= min_labelled}
    pools = defaultdict(lambda: [0, 0, 0])
    for key, k in band.items():
        pool = pools[key[0], key[1], k]
        pool[0], pool[1], pool[2] = pool[0] + branch[key][0], pool[1] + branch[key][1], pool[2] + 1
    name = {}
    for key, k in band.items():
        pb, pm, n = pools[key[0], key[1], k]
        b, m = branch[key]
        if n > 1 and abs(b / m - pb / pm) <= z * math.sqrt(pb / pm * (1 - pb / pm) / m):
            name[key] = f"*{k}"
    final = [tuple(name.get((h, segs[:k], s), s) for k, s in enumerate(segs)) for (_, h, _, _, _), segs in zip(pages, shaped, strict=True)]
    at, below = defaultdict(Counter), defaultdict(Counter)
    for (_, h, _, _, label), t in zip(pages, final, strict=True):
        at[h, t][label] += 1
        for k in range(len(t) + 1):
            below[h, t[:k]][label] += 1
    prior = sum(p[4] == "block" for p in pages) / max(len(pages), 1)
    out = []
    for (i, h, _, ruled, _), t in zip(pages, final, strict=True):
        some, whole = at[h, t], below[h, t]
        score = prior
        if some["block"] + some["allow"] >= min_labelled:
            score = (some["block"] + strength * prior) / (some["block"] + some["allow"] + strength)
        elif 2 * (whole["block"] + whole["allow"]) >= whole.total():
            score = (whole["block"] + strength * prior) / (whole["block"] + whole["allow"] + strength)
        out.append((i, "/" + "/".join(t), ruled or ("block" if score >= threshold else "allow")))
    return out


ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def template(text, common, units, names=True):
    """(form, value) of each word."""
    out = []
    for w in re.findall(r"[^ \t\n\x0b\f\r]+", text or ""):
        bare = w.strip(".,;:!?()[]{}\"'|#&$%*<>")
        if not bare:
            continue
        low = bare.lower()
        tens, _, one = low.partition("-")
        if re.match("[-+\u2212\u2013~\u20ac\u00a3]{0,2}[0-9]", bare) or low in ONES or (tens in TENS and (one in ONES[1:10] or low == tens)):
            form = 1
        elif out and out[-1][0] == 1 and low in units:
            form = 2
        elif names and re.match("[A-Z\u00c0-\u00de]", bare) and any(c.islower() for c in bare) and bare not in common:
            form = 3
        else:
            form = low
        out.append((form, low))
    return out


def leaks(docs, items, common, units, window=5, least=0.8, agree=0.8):
    """{doc: items} by plain search: an item's windows in the document, and one value for each of its values in some occurrence."""
    windows = lambda t: {i: tuple(f for f, _ in t[i : i + window]) for i in range(max(len(t) - window, 0) + 1)} if t else {}
    found = {}
    for d, text, names in ((*x, n) for x in docs for n in (True, False)):
        own = template(text, common, units, names)
        mine = windows(own)
        found.setdefault(d, set())
        for item, question in items:
            theirs = template(question, common, units, names)
            book = windows(theirs)
            size, wide = len(set(book.values())), max(book, default=0) + window
            book = {k: v for v, k in {v: k for k, v in sorted(book.items(), reverse=True)}.items()}  # a window's first place
            met = [(i, k) for k, v in book.items() for i, u in mine.items() if u == v]
            if not size or len({book[k] for _, k in met}) < least * size - 1e-9:
                continue
            count = Counter(i - k for i, k in met)
            places = defaultdict(list)
            for i, k in met:
                for place in ((0, i - k), (1, (i - k) // wide), (2, math.floor((i - k) / wide + 0.5)), (3, None)):
                    places[place].append((i, k))
            for (kind, _), all_ in places.items():
                best = {}
                for i, k in sorted(all_, key=lambda p: (count[p[0] - p[1]], p[1] - p[0])):
                    best[k, i if kind == 3 else None] = (i, k)
                if len({book[k] for _, k in best.values()}) < least * size - 1e-9:
                    continue
                votes = defaultdict(Counter)
                for i, k in best.values():
                    for (form, a), (_, b) in zip(theirs[k : k + window], own[i : i + window], strict=True):
                        if form in (1, 2, 3):
                            votes[a][b] += 1
                total = sum(c.total() for c in votes.values())
                if not total or sum(max(c.values()) for c in votes.values()) / total >= agree:
                    found[d].add(item)
    return found


def license_detections(text, rules):
    """(labels, score, n_found) by trying every rule at every word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    found = []
    for i in range(len(words)):
        rest = " ".join(words[i : i + 60])
        for priority, label, key, before, pattern, weight, base in rules:
            if words[i + before : i + before + 1] == [key] and (m := re.match(f"({pattern})(?: |$)", rest)):
                found.append((i, i + len(m[1].split(" ")), priority, label, weight, base))
    stay = []
    for d in sorted(found, key=lambda d: (d[2], d[0])):
        near = [k for k in stay if k[0] < d[1] and k[1] > d[0]]
        if all(d[0] <= k[0] and k[1] <= d[1] and k[1] - k[0] < d[1] - d[0] for k in near):
            stay = [k for k in stay if k not in near] + [d]
    kept, n = [(d[3], d[4]) for d in found if d[5] or d in stay], len(stay)
    return ",".join(sorted({x for x, _ in kept})), max((w for _, w in kept), default=0.0), n
