"""Links of several shapes, and their components by a plain search."""


def all_of(rng):
    chain = [(i, i + 1) for i in range(60)]
    names = list(range(1000, 1061))
    rng.shuffle(names)
    return {
        "none": [], "one": [(3, 9)], "chain": chain, "shuffled chain": [(names[a], names[b]) for a, b in chain],
        "star": [(0, i) for i in range(1, 80)], "two stars": [(0, i) for i in range(1, 40)] + [(50, i) for i in range(51, 90)],
        "caterpillar": [(10 * i, 10 * i + 10) for i in range(12)] + [(10 * i, 1000 * i + k) for i in range(1, 12) for k in range(1, i)],
        "any": [(a, b) for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(110)) if a != b],
        "repeats": [(1, 2)] * 30 + [(2, 1)] * 3 + [(4, 5)],
    }


def joined(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for node in near:
        todo = [node] if node not in out else []
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = node
                todo += near[at]
    return out
