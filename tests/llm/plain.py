"""Plain versions of the operators, written from their definitions, one text or one pair at a time."""

import datetime
import hashlib
import re

import numpy as np
import xxhash

from quern.llm import pii

# pseudonyms


def stream(bits, *parts):
    return hashlib.new(f"sha{bits}", "|".join(map(str, parts)).encode()).hexdigest()


def feistel(s, key, tweak):
    def moved(c, by):
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            if ord(first) <= ord(c) < ord(first) + size:
                return chr(ord(first) + (ord(c) - ord(first) + by) % size)
        return c

    a, b = s[: (len(s) + 1) // 2], s[(len(s) + 1) // 2 :]
    for n in range(8):
        h = stream(512, key, tweak, n, b)
        a, b = b, "".join(moved(c, int(h[4 * (i % 32) :][:4], 16)) for i, c in enumerate(a))
    return a + b


def pair(a, b, size, key, tweak):
    for n in range(8):
        a, b = b, (a + int(stream(256, key, tweak, n, b)[:12], 16)) % size
    return a, b


def refill(shape, chars, cls):
    chars = iter(chars)
    return "".join(next(chars) if re.match(f"[{cls}]", c) else c for c in shape)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def is_card(d):
    return 13 <= len(d) <= 19 and re.match(f"(?:{pii.ISSUERS})", d) is not None and luhn(d) == 0


def is_iban(s):
    return len(s) >= 12 and mod97(s[4:] + s[:4]) == 1


def card(m, key):
    d = re.sub(r"\D", "", m)
    if not is_card(d):
        return m
    kept = 1 if d[0] == "4" else 4
    body = d[:kept] + feistel(d[kept:-1], key, "card")
    return refill(m, body + str(-luhn(body + "0") % 10), "0-9")


def iban(m, key):
    s = m.replace(" ", "")
    if mod97(s[4:] + s[:4]) != 1:
        return m
    account = feistel(s[4:], key, "iban")
    return refill(m, f"{s[:2]}{98 - mod97(account + s[:2] + '00'):02d}{account}", "A-Z0-9")


def ssn(m, key):
    area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return m
    a, b = (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1
    for n in range(8):
        if n % 2 == 0:
            a = (a + int(stream(256, key, "ssn", n, b)[:12], 16)) % (898 * 99)
        else:
            b = (b + int(stream(256, key, "ssn", n, a)[:12], 16)) % 9999
    area = a // 99 + 1
    return f"{area + (area >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def ipv4(m, key):
    o = list(map(int, m.split(".")))
    a, b = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, key, "ipv4")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(m, key):
    p, sep, first = re.split(r"\D", m), re.search(r"\D", m)[0], datetime.date(1800, 1, 1)

    def day(y, mo, d):
        try:
            return datetime.date(int(y), int(mo), int(d))
        except ValueError:
            return None

    orders = ("ymd",) if len(p[0]) == 4 else ("dmy", "mdy")
    for order in orders:
        y, mo, d = (p[order.index(c)] for c in "ymd")
        if found := day(y, mo, d):
            break
    else:
        return m
    n, half = (found - first).days, 340
    if not 0 <= n < half * half:
        return m
    a, b = pair(n // half, n % half, half, key, "date")
    new = first + datetime.timedelta(days=a * half + b)
    wide = order == "ymd" or (len(p[0]) == len(p[1]) == 2)
    told = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if wide else str(new.month), "d": f"{new.day:02d}" if wide else str(new.day)}
    return sep.join(told[c] for c in order)


def phone(m, key):
    d = re.sub(r"\D", "", m)
    if not 7 <= len(d) <= 15:
        return m
    own = min(len(d) - m.startswith("+"), 10)
    return refill(m, d[:-own] + feistel(d[-own:], key, "phone"), "0-9")


def email(m, key):
    local, at, domain = m.partition("@")
    return feistel(local, key, "email") + at + domain


def credential(m, key):
    name = re.match(r'(?:A[KS]IA|(?i:[a-z_]+)\s?[=:]\s?"?)', m)[0]
    return name + feistel(m[len(name) :], key, "credential")


def mac(m, key):
    flat = m.replace(":", "")
    a, b = pair(int(flat[:6], 16), int(flat[6:], 16), 1 << 24, key, "mac")
    out = ":".join(re.findall("..", f"{a:06x}{b:06x}"))
    if not re.search("[A-F]", m):
        return out
    if not re.search("[a-f]", m):
        return out.upper()
    return "".join(x.upper() if "A" <= c <= "F" else x for c, x in zip(m, out))


KINDS = {"email": email, "credential": credential, "iban": iban, "mac": mac, "ipv4": ipv4, "date": date, "ssn": ssn, "card": card, "phone": phone}
ANY = re.compile(pii.ANY)


def pseudonymized(text, key):
    """The text and how many values were replaced."""
    if text is None:
        return None, 0
    out, n, at = [], 0, 0
    while m := ANY.search(text, at):
        # what a shorter reading leaves over is read as the start of a text of its own, up to the next match
        out.append(text[at : m.start()])
        kind = next(k for k, p in pii.PATTERNS.items() if re.fullmatch(p, m[0]))
        ends = [i for i in range(len(m[0]), 0, -1) if i == len(m[0]) or m[0][i] == " "]
        valid = {"card": lambda v: is_card(re.sub(r"\D", "", v)), "iban": lambda v: is_iban(v.replace(" ", ""))}.get(kind)
        end = next((i for i in ends if valid(m[0][:i])), len(m[0])) if valid else len(m[0])
        value = m[0][:end]
        new = KINDS[kind](value, key)
        out.append(new)
        n += new != value
        if end < len(m[0]):
            following = ANY.search(text, m.end())
            stop = following.start() if following else len(text)
            part, k = pseudonymized(text[m.start() + end : stop], key)
            out.append(part)
            n += k
            at = stop
        else:
            at = m.end()
    return "".join(out) + text[at:], n


# near duplicates


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text, k):
    w = words(text)
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    return [xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams]


def simhash(hashes):
    ones = np.zeros(64, dtype=int)
    for h in hashes:
        ones += np.frombuffer(f"{h:064b}".encode(), dtype=np.uint8) - 48
    return int("".join("1" if 2 * n > len(hashes) else "0" for n in ones), 2)


def components(ids, linked):
    """The smallest id that links reach from each id, by all pairs of positions."""
    of = list(range(len(ids)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)), key=lambda x: (ids[x], x))
                of[b] = a
    return [ids[find(i)] for i in range(len(ids))]


def near_duplicates(rows, k=5, similarity=0.8):
    """Rows (id, text) of which each component's smallest id stays."""
    hashes = [shingles(t, k) for _, t in rows]
    prints, sets = [simhash(h) for h in hashes], [set(h) for h in hashes]
    close = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9
    of = components([i for i, _ in rows], close)
    return [r for r, c in zip(rows, of, strict=True) if r[0] == c]


# packing


def best_fit_decreasing(lengths, capacity):
    """Number of bins."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


# outliers


def least_covariance(x, share, tolerance, starts=60, seed=1):
    """Mean and covariance of the share of rows with the smallest determinant, from many random starts, each drawn on until it stays."""
    r, h = np.random.default_rng(seed), int(np.ceil(share * len(x)))
    best = None
    for _ in range(starts):
        rows = r.choice(len(x), size=min(len(x), x.shape[1] + 2), replace=False)
        for _ in range(60):
            mean, cov = x[rows].mean(axis=0), np.cov(x[rows].T, bias=True) + np.diag(np.square(tolerance))
            dev = x - mean
            order = np.argsort(np.einsum("ij,jk,ik->i", dev, np.linalg.inv(cov), dev), kind="stable")[:h]
            if set(order) == set(rows):
                break
            rows = order
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = (det, x[rows].mean(axis=0), np.cov(x[rows].T, bias=True))
    return best[1], best[2]
