"""Brute force that several tests share."""


def shingles(text, width):
    words = bytes(text or "", "utf-8").lower().split()
    return {tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def near_groups(rows, width, percent=80):
    """id -> least id that similar documents lead to."""
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def of(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = of(a), of(b)
                label[max(x, y)] = min(x, y)
    return {i: of(i) for i in ids}
