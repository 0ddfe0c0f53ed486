"""Cell lineages: binary rooted trees as nested pairs of sample numbers, and likelihoods of genotypes along them."""

from __future__ import annotations

import itertools

import numpy as np

from .text import Twig

#: A sample's number, or a pair of trees.
Tree = int | tuple
GENOTYPES3 = ("RR", "RA", "AA")
GENOTYPES10 = ("AA", "AC", "AG", "AT", "CC", "CG", "CT", "GG", "GT", "TT")
#: Changes that have twice the chance that the rule of `matrix10` gives, as in the published method.
DOUBLED = (("AC", "AA"), ("AC", "CC"), ("AG", "AA"), ("AT", "AA"))


def matrix3(mu: float) -> np.ndarray:
    """Of RR, RA, AA; mu as phred."""
    u = 10 ** (-mu / 10)
    v = 1 - u
    return np.array([[v * v, 2 * u * v, u * u], [v * u, u * u + v * v, v * u], [u * u, 2 * u * v, v * v]])


def matrix10(mu: float) -> np.ndarray:
    """Each of the two alleles stays or becomes any one of the three others, by itself."""
    u = 10 ** (-mu / 10)
    turn = lambda x, y: 1 - u if x == y else u / 3

    def chance(a: str, b: str) -> float:
        straight, crossed = turn(a[0], b[0]) * turn(a[1], b[1]), turn(a[0], b[1]) * turn(a[1], b[0])
        return (straight + (crossed if b[0] != b[1] else 0.0)) * (2 if (a, b) in DOUBLED else 1)

    return np.array([[chance(a, b) for b in GENOTYPES10] for a in GENOTYPES10])


def matrices(g: int, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all, unchanged only, changed only)."""
    m = matrix3(mu) if g == 3 else matrix10(mu)
    same = np.diag(m.diagonal())
    return m, same, m - same


def phred_sum(x: np.ndarray, axis) -> np.ndarray:
    """Phred of the sum of chances."""
    low = x.min(axis=axis, keepdims=True)
    low = np.where(np.isfinite(low), low, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(low, axis) - 10 * np.log10((10 ** (-(x - low) / 10)).sum(axis=axis))


def base_prior(het: float, kinds: tuple[str, ...]) -> np.ndarray:
    x = np.array([het if k[0] != k[1] else 0.0 for k in kinds], float)
    return x - phred_sum(x, 0)


def _along(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A branch's lower end to its upper one, phred to phred."""
    low = x.min(axis=-1, keepdims=True)
    low = np.where(np.isfinite(low), low, 0.0)
    with np.errstate(divide="ignore"):
        return low - 10 * np.log10(10 ** (-(x - low) / 10) @ m)


def leaves(t: Tree) -> list[int]:
    return [t] if isinstance(t, int) else [x for c in t for x in leaves(c)]


def branches(t: Tree) -> list[list[int]]:
    """Samples below each branch, children before parents."""
    return [] if isinstance(t, int) else [b for c in t for b in [*branches(c), leaves(c)]]


def node_values(t: Tree, pl: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """[site, genotype] at the root, and at the lower end of each branch in the order of `branches`."""
    if isinstance(t, int):
        return pl[:, t], []
    total, below = 0.0, []
    for c in t:
        value, inner = node_values(c, pl, m)
        below += [*inner, value]
        total = total + _along(value, m)
    return total, below


def mutated_values(t: Tree, pl: np.ndarray, same: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root values without mutation, [branch, site, genotype] root values with the one mutation on that branch)."""
    if isinstance(t, int):
        return pl[:, t], np.zeros((0, len(pl), pl.shape[2]))
    (a, am), (b, bm) = (mutated_values(c, pl, same, changed) for c in t)
    up = [_along(x, same) for x in (a, b)]
    out = []
    for mine, inner, other in ((a, am, up[1]), (b, bm, up[0])):
        if len(inner):
            out.append(_along(inner, same) + other)
        out.append((_along(mine, changed) + other)[None])
    return up[0] + up[1], np.concatenate(out)


def site_scores(t: Tree, pl: np.ndarray, mu: float, het: float) -> np.ndarray:
    """Phred of no or one mutation anywhere, of each site of [site, sample, genotype]."""
    g = pl.shape[2]
    _, same, changed = matrices(g, mu)
    prior = base_prior(het, GENOTYPES3 if g == 3 else GENOTYPES10)
    none, one = mutated_values(t, pl, same, changed)
    return phred_sum(np.concatenate([(none + prior)[None], one + prior]), (0, 2))


def place(t: Tree, pl: np.ndarray, mu: float, het: float) -> dict[str, np.ndarray]:
    """Of each site: chances of no and of one mutation, likeliest genotypes with and without, and the branch."""
    g = pl.shape[2]
    kinds = GENOTYPES3 if g == 3 else GENOTYPES10
    m, same, changed = matrices(g, mu)
    prior = base_prior(het, kinds)
    all_ = phred_sum(node_values(t, pl, m)[0] + prior, 1)
    none, one = mutated_values(t, pl, same, changed)
    none, one = none + prior, one + prior
    n = np.arange(len(pl))
    flat = one.transpose(1, 0, 2).reshape(len(pl), -1)
    at = flat.argmin(1)
    branch, base = at // g, at % g
    below = np.array(node_values(t, pl, same)[1])
    ratio = lambda x: 10 ** (-(x - all_) / 10)
    names = np.array(kinds)
    return {
        "null_p": ratio(phred_sum(none, 1)),
        "mut_p": ratio(phred_sum(flat, 1)),
        "null_base": names[none.argmin(1)],
        "null_base_p": ratio(none.min(1)),
        "mut_base": names[base],
        "mut_alt": names[below[branch, n].argmin(1)],
        "mut_conf_p": ratio(flat[n, at]),
        "mut_loc": branch.astype(np.int32),
    }


def neighbour_joining(d: np.ndarray) -> Tree:
    """Of a symmetric matrix; the last two are the root's children. Ties: the first pair."""
    d = np.array(d, float)
    trees: list[Tree] = list(range(len(d)))
    while len(trees) > 2:
        m = len(trees)
        u = d.sum(1) / (m - 2)
        q = d - u[:, None] - u[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(q.argmin()), m)
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(m) if k not in (i, j)]
        e = np.zeros((m - 1, m - 1))
        e[:-1, :-1] = d[np.ix_(keep, keep)]
        e[-1, :-1] = e[:-1, -1] = new[keep]
        d, trees = e, [*(trees[k] for k in keep), (trees[i], trees[j])]
    return trees[0] if len(trees) == 1 else (trees[0], trees[1])


def canonical(t: Tree) -> Tree:
    """Children by their smallest sample."""
    if isinstance(t, int):
        return t
    return tuple(sorted((canonical(c) for c in t), key=lambda c: min(leaves(c))))


def exchanges(t: Tree) -> list[Tree]:
    """All trees one nearest-neighbour exchange away."""
    if isinstance(t, int):
        return []
    a, b = t
    out = [(x, b) for x in exchanges(a)] + [(a, x) for x in exchanges(b)]
    for inner, other in ((a, b), (b, a)):
        if not isinstance(inner, int):
            x, y = inner
            out += [((x, other), y), ((y, other), x)]
    return out


def rerooted(t: Tree) -> list[Tree]:
    """All trees of the same shape with the root on another branch."""
    if isinstance(t, int):
        return []
    out: list[Tree] = []

    def walk(node: Tree, rest: Tree) -> None:
        if isinstance(node, int):
            return
        x, y = node
        for inner, other in ((x, y), (y, x)):
            beyond = (other, rest)
            out.append((inner, beyond))
            walk(inner, beyond)

    walk(t[0], t[1])
    walk(t[1], t[0])
    return out


def neighbours(t: Tree) -> list[Tree]:
    found = {canonical(x): None for x in [*exchanges(t), *rerooted(t)]}
    found.pop(canonical(t), None)
    return list(found)


def to_text(t: Tree, names: list[str], lengths: dict[frozenset[int], int] | None = None) -> str:
    def one(x: Tree) -> str:
        tail = f":{lengths.get(frozenset(leaves(x)), 0)}" if lengths is not None else ""
        return (names[x] if isinstance(x, int) else f"({','.join(map(one, x))})") + tail

    return f"({','.join(map(one, t))});" if not isinstance(t, int) else f"{names[t]};"


def from_twig(t: Twig, names: list[str]) -> Tree:
    if not t.children:
        return names.index(t.label)
    kids = [from_twig(c, names) for c in t.children]
    if len(kids) == 1:
        return kids[0]
    if len(kids) > 2:
        raise ValueError("a node has more than two children")
    return tuple(kids)


def _splits(t: Tree, everything: frozenset[int]) -> set[frozenset[frozenset[int]]]:
    return {frozenset((frozenset(b), everything - frozenset(b))) for b in branches(t)}


def _between(t: Tree) -> dict[tuple[int, int], int]:
    """Nodes between each two samples."""
    paths: dict[int, list[int]] = {}
    number = itertools.count()

    def walk(x: Tree, above: list[int]) -> None:
        if isinstance(x, int):
            paths[x] = above
            return
        own = [*above, next(number)]
        for c in x:
            walk(c, own)

    walk(t, [])
    out = {}
    for i, j in itertools.combinations(sorted(paths), 2):
        shared = len(set(paths[i]) & set(paths[j]))
        out[i, j] = len(paths[i]) + len(paths[j]) - 2 * shared + 1
    return out


def compare(ref: Tree, t: Tree) -> dict[str, float]:
    """norm_rf of unrooted trees, shares of edges found in the other, mean difference and geometric ratio of distances."""
    all_ = frozenset(leaves(ref))
    if all_ != frozenset(leaves(t)):
        raise ValueError("the trees have different samples")
    a, b = _splits(ref, all_), _splits(t, all_)
    inner = lambda s: sum(all(len(side) > 1 for side in x) for x in s)
    most = inner(a) + inner(b)
    x, y = _between(ref), _between(t)
    pairs = list(x)
    ratio = [min(x[k], y[k]) / max(x[k], y[k]) for k in pairs]
    return {
        "norm_rf": len(a ^ b) / most if most else 0.0,
        "ref_edges_in_tree": len(a & b) / len(a),
        "tree_edges_in_ref": len(a & b) / len(b),
        "distance": float(np.mean([abs(x[k] - y[k]) for k in pairs])),
        "ratio": float(np.exp(np.mean(np.log(ratio)))),
    }


def drawn(t: Tree, names: list[str], labels: dict[str, str] | None = None) -> str:
    """Lines of text, one a node."""
    out: list[str] = []

    def walk(x: Tree, lead: str, last: bool, top: bool) -> None:
        mark = "" if top else ("`-" if last else "|-")
        name = "" if not isinstance(x, int) else names[x] + (f" {labels[names[x]]}" if labels and names[x] in labels else "")
        out.append(f"{lead}{mark}{name or '+'}")
        if not isinstance(x, int):
            for k, c in enumerate(x):
                walk(c, lead + ("" if top else ("  " if last else "| ")), k == len(x) - 1, False)

    walk(t, "", True, True)
    return "\n".join(out)
