"""Plain versions shared by the tests of this folder."""

import re


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    """Words of the contracts: runs without space, tab, line or page breaks."""
    return re.findall("[^\x20\x09-\x0D]+", ascii_lower(t or ""))


def roots(ids, links):
    """Smallest id reachable, by plain union-find."""
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
