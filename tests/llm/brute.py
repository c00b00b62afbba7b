"""Plain forms that several tests hold operators against."""

from setwise.llm.texts import space_words


def similar_pairs(texts, k, percent):
    """All linked pairs of a few (key, text): sets of word tuples, no hashing."""
    sets = []
    for key, text in texts:
        w = space_words(text, lower=True)
        sets.append((key, {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()))
    return [
        (a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :]
        if x and y and 100 * len(x & y) >= percent * len(x | y)]


def components(keys, links):
    """Smallest key reachable from each key."""
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}
