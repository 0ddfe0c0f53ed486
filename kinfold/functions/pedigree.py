"""Pedigrees of any shape without loops: from members to a graph, and exact inference over it for batches of sites.

The graph is built once on the driver and travels with the tasks; it grows with the pedigree, not with the data.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np

from . import model as M
from .text import Member, Twig, parse_newick


@dataclass
class Node:
    label: str
    kind: str
    sex: str
    ploidy: int
    #: (parent, length, "dad" / "mom" / "mitotic" / "library"); none for founders, two for children of two parents.
    ups: list[tuple[int, float, str]] = field(default_factory=list)
    library: str = ""
    #: Of the kinds of branches that lead here from the parents.
    flags: frozenset[str] = frozenset()


@dataclass
class Graph:
    nodes: list[Node]
    libraries: list[str]

    def __post_init__(self) -> None:
        self.families = families(self.nodes)


def _has(m: Member, *tags: str) -> bool:
    return any(t.lower() in tags for t in m.tags)


def _check(members: list[Member]) -> None:
    by = {m.name: m for m in members}
    for m in members:
        if _has(m, "founder") or (m.dad is None and m.mom is None):
            continue
        single = _has(m, "clone") or _ploidy(m) == 1
        if single and m.dad is not None and m.mom is not None:
            raise ValueError(f"'{m.name}' is a clone or gamete of two parents")
        if not single and (m.dad is None or m.mom is None):
            raise ValueError(f"a parent of '{m.name}' is unspecified")
        for who in (m.dad, m.mom):
            if who is not None and who not in by:
                raise ValueError(f"a parent of '{m.name}' is unknown")
        if _has(m, "clone"):
            continue
        if m.dad is not None and by[m.dad].sex == "female":
            raise ValueError(f"the father of '{m.name}' is female")
        if m.mom is not None and by[m.mom].sex == "male":
            raise ValueError(f"the mother of '{m.name}' is male")
        if m.dad is not None and m.dad == m.mom:
            raise ValueError(f"the parents of '{m.name}' are the same")


def _ploidy(m: Member) -> int:
    if _has(m, "haploid", "gamete", "p=1", "ploidy=1"):
        return 1
    return 2


def _somatic(nodes: list[Node], at: int, samples: tuple[str, ...], normalize: bool) -> None:
    """A tree for each sample text, below germline node `at`; the tip's height is 1 if normalised."""
    for text in samples:
        tree = parse_newick(text)
        height = lambda t: t.length + max(map(height, t.children), default=0.0)
        top = height(tree)
        scale = (1 / top if top else 0.0) if normalize else 1.0

        def add(t: Twig, parent: int) -> None:
            nodes.append(Node(t.label, "somatic", nodes[at].sex, nodes[at].ploidy, [(parent, t.length * scale, "mitotic")]))  # noqa: B023
            own = len(nodes) - 1
            for c in reversed(t.children):
                add(c, own)

        add(tree, at)


def _prune(nodes: list[Node], model: str) -> None:
    """Drop the branches along which the chromosome isn't passed on, and set the ploidies."""
    if model in ("maternal", "paternal"):
        gone = "dad" if model == "maternal" else "mom"
        for n in nodes:
            n.ups = [u for u in n.ups if u[2] != gone]
            n.ploidy = 1
        return
    if model == "autosomal":
        return
    # XY and ZW mirror each other: who has both chromosomes, and from whom the lone one comes.
    single, lone, other = {"x": ("male", "male", "dad"), "y": ("male", "male", "mom"), "z": ("female", "female", "mom"), "w": ("female", "female", "dad")}[model[0]]
    touched = {u[0] for n in nodes for u in n.ups} | {i for i, n in enumerate(nodes) if n.ups}
    if model[0] in "xz":
        for n in nodes:
            if n.sex == lone:
                n.ups = [] if n.ploidy == 1 else [u for u in n.ups if u[2] != other]
    else:
        for n in nodes:
            n.ups = [u for u in n.ups if u[2] != other] if n.sex == single else []
    for i, n in enumerate(nodes):
        if n.sex not in ("male", "female") and i in touched:
            raise ValueError(f"{model} inheritance requires every individual to have a known sex")
        if n.sex == single:
            n.ploidy = 1
        elif model[0] in "yw":
            n.ploidy = 0


def _simplify(nodes: list[Node]) -> list[Node]:
    """Drop what leads to no library; join a node's branch with its only child's if no other parent shares the child."""
    alive = [True] * len(nodes)
    below: list[list[int]] = [[] for _ in nodes]
    for i, n in enumerate(nodes):
        for p, _, _ in n.ups:
            below[p].append(i)
    order = _parents_first(nodes)
    for v in reversed(order):
        n = nodes[v]
        if n.kind == "library":
            alive[v] = n.ploidy > 0
            if not alive[v]:
                n.ups = []
            continue
        kids = [c for c in below[v] if alive[c]]
        if not kids:
            alive[v], n.ups = False, []
            continue
        if len(kids) > 1 or not n.ups or len(nodes[kids[0]].ups) > 1:
            continue
        child = nodes[kids[0]]
        if len(n.ups) == 2 and child.ploidy != 2:
            continue
        extra = child.ups[0][1]
        child.ups = [(p, length + extra, kind) for p, length, kind in n.ups]
        child.flags = child.flags | n.flags
        for p, _, _ in n.ups:
            below[p].append(kids[0])
        alive[v], n.ups = False, []
    kept = [i for i in range(len(nodes)) if alive[i] and nodes[i].ploidy > 0]
    rank = {"germline": 1, "somatic": 2, "library": 3}
    kept.sort(key=lambda i: (0 if nodes[i].kind == "germline" and not nodes[i].ups else rank[nodes[i].kind], i))
    new = {old: k for k, old in enumerate(kept)}
    for i in kept:
        nodes[i].ups = [(new[p], length, kind) for p, length, kind in nodes[i].ups if p in new]
    return [nodes[i] for i in kept]


def _parents_first(nodes: list[Node]) -> list[int]:
    done, order = [False] * len(nodes), []

    def visit(i: int) -> None:
        stack = [(i, False)]
        while stack:
            v, ready = stack.pop()
            if done[v]:
                continue
            if ready:
                done[v] = True
                order.append(v)
            else:
                stack.append((v, True))
                stack += [(p, False) for p, _, _ in nodes[v].ups if not done[p]]

    for i in range(len(nodes)):
        visit(i)
    return order


def build(members: list[Member], libraries: list[tuple[str, str]], model: str = "autosomal", mu: float = 1e-8, mu_somatic: float = 0.0, mu_library: float = 0.0, normalize: bool = True) -> Graph:
    """The graph of a pedigree and of the (library, sample) pairs in the data; libraries of other samples are left out."""
    _check(members)
    index = {m.name: m for m in members}
    of: dict[str, list[tuple[Member, str]]] = {m.name: [] for m in members}
    founders = [m for m in members if _has(m, "founder") or (m.dad is None and m.mom is None)]
    for m in members:
        if m in founders:
            continue
        for who, role in ((m.dad, "dad"), (m.mom, "mom")):
            if who is not None:
                of[who].append((m, role))
    germ: list[Node] = []
    place: dict[str, int] = {}
    queue: deque[Member] = deque()

    def add(m: Member, ups: list[tuple[int, float, str]]) -> None:
        ploidy = _ploidy(m)
        sex = m.sex
        if ups and _has(m, "clone"):
            ploidy, sex = germ[ups[0][0]].ploidy, germ[ups[0][0]].sex
        germ.append(Node(m.name, "germline", sex, ploidy, ups))
        place[m.name] = len(germ) - 1
        queue.append(m)

    for m in founders:
        add(m, [])
    while queue:
        parent = queue.popleft()
        for child, role in of[parent.name]:
            if child.name in place:
                continue
            length = child.dad_length if role == "dad" else child.mom_length
            if _has(child, "clone"):
                add(child, [(place[parent.name], length, "mitotic")])
            elif _ploidy(child) == 1:
                add(child, [(place[parent.name], length, role)])
            elif child.dad in place and child.mom in place:
                add(child, [(place[child.dad], child.dad_length, "dad"), (place[child.mom], child.mom_length, "mom")])
    if len(germ) != len(members):
        raise ValueError("a member is its own ancestor")
    nodes = list(germ)
    for k in range(len(germ)):
        _somatic(nodes, k, index[germ[k].label].samples, normalize)
    by_sample = {n.label: i for i, n in enumerate(nodes) if n.kind == "somatic" and n.label}
    for library, sample in libraries:
        at = by_sample.get(sample)
        if at is not None:
            nodes.append(Node(sample if library == sample else f"{sample}/{library}", "library", nodes[at].sex, nodes[at].ploidy, [(at, 1.0, "library")], library))
    rates = {"dad": mu, "mom": mu, "mitotic": mu_somatic, "library": mu_library}
    names = {"dad": "germline", "mom": "germline", "mitotic": "somatic", "library": "library"}
    _prune(nodes, model)
    for n in nodes:
        n.ups = [(p, float(np.float32(length * rates[kind])), kind) for p, length, kind in n.ups]
        n.flags = frozenset(names[kind] for _, _, kind in n.ups)
    nodes = _simplify(nodes)
    prefix = {"germline": "GL/", "somatic": "SM/", "library": "LB/"}
    for i, n in enumerate(nodes):
        n.label = prefix[n.kind] + (n.label or f"unnamed_node_{i}")
    return Graph(nodes, [n.library for n in nodes if n.kind == "library"])


@dataclass
class Family:
    parents: tuple[int, ...]
    children: list[int]


def families(nodes: list[Node]) -> list[Family]:
    """Couples with their children, and lone parents with one child each; refuses pedigrees with loops."""
    couples: dict[tuple[int, ...], Family] = {}
    out: list[Family] = []
    for i, n in enumerate(nodes):
        if not n.ups:
            continue
        parents = tuple(p for p, _, _ in sorted(n.ups, key=lambda u: u[2] == "mom"))
        if len(parents) == 1:
            out.append(Family(parents, [i]))
        elif parents in couples:
            couples[parents].children.append(i)
        else:
            couples[parents] = Family(parents, [i])
            out.append(couples[parents])
    root = list(range(len(nodes) + len(out)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, f in enumerate(out):
        for v in (*f.parents, *f.children):
            a, b = find(v), find(len(nodes) + k)
            if a == b:
                raise ValueError("the pedigree has a loop")
            root[a] = b
    return out


def _diploid(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Both alleles of a diploid cell, each by its own matrix; phases folded."""
    at = M.pairs(len(first))
    one = lambda x, y, b, a: first[x, a] * second[y, b] + (first[x, b] * second[y, a] if a != b else 0.0)
    return np.array([[one(x, y, b, a) for b, a in at] for y, x in at])


def transition(node: Node, nodes: list[Node], n: int, k: float, kind: str) -> np.ndarray:
    """[parents..., child] of n alleles; kind: full, none (no mutation), one (exactly one), mean (expected number)."""

    def alleles(u: float, what: str) -> np.ndarray:
        return {"full": M.allele_matrix, "mean": M.mean_matrix}[what](n, u, k) if what in ("full", "mean") else M.event_matrix(n, u, k, int(what == "one"))

    def gamete(p: int, u: float, what: str) -> np.ndarray:
        return M.gametes(alleles(u, what)) if nodes[p].ploidy == 2 else alleles(u, what)

    #: Which of two independent lines has the events.
    lines = {"full": [("full", "full")], "none": [("none", "none")], "one": [("one", "none"), ("none", "one")], "mean": [("mean", "full"), ("full", "mean")]}[kind]
    ups = sorted(node.ups, key=lambda u: u[2] == "mom")
    if len(ups) == 2:
        return sum(M.child(gamete(ups[0][0], ups[0][1], a), gamete(ups[1][0], ups[1][1], b)) for a, b in lines)
    p, u, _ = ups[0]
    if node.ploidy == 1:
        return gamete(p, u, kind)
    if nodes[p].ploidy != 2:
        raise ValueError(f"'{node.label}' is diploid, its only parent isn't")
    return sum(_diploid(alleles(u, a), alleles(u, b)) for a, b in lines)


class Peeler:
    """Messages over the graph for one number of alleles; all arrays are [site, ...]."""

    def __init__(self, graph: Graph, n: int, p: M.Parameters):
        self.graph, self.n, self.p = graph, n, p
        nodes = graph.nodes
        self.arrays = {kind: {i: transition(v, nodes, n, p.k_alleles, kind) for i, v in enumerate(nodes) if v.ups} for kind in ("full", "none", "one", "mean")}
        self.prior = {1: M.haploid_prior(n, p), 2: M.diploid_prior(n, p)}
        self.near: list[list[int]] = [[] for _ in nodes]
        for k, f in enumerate(graph.families):
            for v in (*f.parents, *f.children):
                self.near[v].append(k)
        # An order of (node, family) edges from the leaves to a root of each component.
        self.order: list[tuple[str, int, int]] = []
        self.roots: list[int] = []
        seen_node, seen_fam = set(), set()
        for r in range(len(nodes)):
            if r in seen_node:
                continue
            self.roots.append(r)
            seen_node.add(r)
            stack, found = [r], []
            while stack:
                v = stack.pop()
                for k in self.near[v]:
                    if k in seen_fam:
                        continue
                    seen_fam.add(k)
                    found.append(("f", k, v))
                    f = graph.families[k]
                    for w in (*f.parents, *f.children):
                        if w not in seen_node:
                            seen_node.add(w)
                            found.append(("n", w, k))
                            stack.append(w)
            self.order += reversed(found)

    def local(self, lik: dict[int, np.ndarray], size: int) -> list[np.ndarray]:
        out = []
        for i, v in enumerate(self.graph.nodes):
            width = self.n * (self.n + 1) // 2 if v.ploidy == 2 else self.n
            x = np.ones((size, width)) if v.ups else np.broadcast_to(self.prior[v.ploidy], (size, width)).copy()
            out.append(x * lik[i] if i in lik else x)
        return out

    @staticmethod
    def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = x.reshape(len(x), -1).max(1)
        top = np.where(top > 0, top, 1.0)
        return x / top.reshape(-1, *[1] * (x.ndim - 1)), np.log(top)

    def _product(self, v: int, but: int | None, local, down) -> np.ndarray:
        x = local[v]
        for k in self.near[v]:
            if k != but:
                x = x * down[k, v]
        return x

    def _above(self, k: int, but: int | None, T, up) -> np.ndarray:
        """Over the parents of family k: their messages, and their children's; without one of these nodes."""
        f = self.graph.families[k]
        if len(f.parents) == 1:
            x = np.ones((1, 1)) if f.parents[0] == but else up[f.parents[0], k]
            for c in f.children:
                if c != but:
                    x = x * (up[c, k] @ T[c].T)
            return x
        x = np.ones((1, 1, 1))
        for axis, v in enumerate(f.parents):
            if v != but:
                x = x * (up[v, k][:, :, None] if axis == 0 else up[v, k][:, None, :])
        for c in f.children:
            if c != but:
                x = x * np.einsum("dmc,sc->sdm", T[c], up[c, k], optimize=True)
        return x

    def _to_node(self, k: int, v: int, T, up) -> np.ndarray:
        f = self.graph.families[k]
        x = self._above(k, v, T, up)
        if v in f.children:
            return x @ T[v] if len(f.parents) == 1 else np.einsum("sdm,dmc->sc", x, T[v], optimize=True)
        if len(f.parents) == 1:
            return x
        return x.sum(2 if f.parents[0] == v else 1)

    def run(self, kind: str, local: list[np.ndarray], back: bool = True):
        """(ln P of the data, messages of nodes to families, messages of families to nodes)."""
        T = self.arrays[kind]
        up: dict[tuple[int, int], np.ndarray] = {}
        down: dict[tuple[int, int], np.ndarray] = {}
        ln = np.zeros(len(local[0]))
        for what, a, b in self.order:
            if what == "n":
                up[a, b], s = self._norm(self._product(a, b, local, down))
            else:
                down[a, b], s = self._norm(self._to_node(a, b, T, up))
            ln = ln + s
        with np.errstate(divide="ignore"):
            for r in self.roots:
                ln = ln + np.log(self._product(r, None, local, down).sum(1))
        if back:
            for what, a, b in reversed(self.order):
                if what == "f":
                    up[b, a], _ = self._norm(self._product(b, a, local, down))
                else:
                    down[b, a], _ = self._norm(self._to_node(b, a, T, up))
        return ln, up, down

    def joint(self, c: int, kind: str, other: str, up) -> tuple[np.ndarray, np.ndarray]:
        """[site, parents, child] with array `other` on c's branch over messages of `kind`, and the total with `kind`'s own."""
        k = next(k for k in self.near[c] if c in self.graph.families[k].children)
        x = self._above(k, c, self.arrays[kind], up)
        x = x.reshape(len(x), -1)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        total = np.einsum("sp,pc,sc->s", x, flat(self.arrays[kind][c]), up[c, k], optimize=True)
        return x[:, :, None] * flat(self.arrays[other][c]) * up[c, k][:, None, :], total


_MEMO: dict = {}


def peeler(graph: Graph, n: int, p: M.Parameters) -> Peeler:
    """One for each graph and number of alleles in a Python process."""
    key = (repr(graph.nodes), n, p)
    if key not in _MEMO:
        if len(_MEMO) > 64:
            _MEMO.clear()
        _MEMO[key] = Peeler(graph, n, p)
    return _MEMO[key]


def _rounded_phred_of_rest(x: np.ndarray, cap: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(cap, np.rint(-10 / np.log(10) * np.log1p(-np.minimum(x, 1.0)))).astype(np.int32)


def one_mutation_prior(graph: Graph, p: M.Parameters) -> float:
    """P(exactly one mutation) with two alleles and no data."""
    q = peeler(graph, 2, p)
    local = q.local({}, 1)
    ln, _, _ = q.run("full", local, back=False)
    zero, up, _ = q.run("none", local)
    return float((_one_total(q, up)[0] * np.exp(zero - ln))[0])


def _one_total(q: Peeler, up):
    total, each = 0.0, {}
    for c, v in enumerate(q.graph.nodes):
        if v.ups:
            x, z = q.joint(c, "none", "one", up)
            each[c] = x / z[:, None, None]
            total = total + each[c].sum((1, 2))
    return total, each


def statistics(graph: Graph, depth: np.ndarray, p: M.Parameters = M.Parameters()) -> dict[str, np.ndarray]:
    """Of sites with [site, library, allele] counts, libraries as in graph.libraries; at most 4 alleles count.

    qual, mutq, mutx, dnp, lld, lls, llh; dnq, dnl (node), dnt_row (parents' genotypes, dad-major), dnt_col (child's);
    and [site, node] gq, gt, mutp, node_dnp; post: a list of [site, genotype] for each node.
    """
    size, n = len(depth), min(4, depth.shape[2])
    q = peeler(graph, n, p)
    libs = [i for i, v in enumerate(graph.nodes) if v.kind == "library"]
    lik, scale, mono = {}, np.zeros(size), np.zeros(size)
    for k, i in enumerate(libs):
        ll = M.genotype_likelihoods(depth[:, k, :n], n, p, graph.nodes[i].ploidy)
        top = ll.max(1)
        lik[i], scale = np.exp(ll - top[:, None]), scale + top
        mono += ll[:, 0] - top
    local = q.local(lik, size)
    one = peeler(graph, 1, p)
    ln_mono = one.run("full", one.local({}, 1), back=False)[0][0] + mono
    ln, up, down = q.run("full", local)
    zero, up0, _ = q.run("none", local)
    to_phred = -10 / np.log(10)
    total = depth[:, :, :n].sum(1).astype(float)
    xlog = lambda x: x * np.log10(np.where(x > 0, x, 1))
    out: dict = {"qual": to_phred * (ln_mono - ln), "mutq": to_phred * (zero - ln), "lld": (ln + scale) / np.log(10)}
    out["lls"] = out["lld"] - (xlog(total).sum(1) - xlog(total.sum(1)))
    out["llh"] = out["lld"] - scale / np.log(10)
    with np.errstate(invalid="ignore", divide="ignore"):
        ones, each = _one_total(q, up0)
        ones = ones + np.zeros(size)
        out["dnp"] = ones * np.exp(zero - ln)
        best, dnl, row, col = np.full(size, -1.0), np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        nodes = len(graph.nodes)
        mutp, dnp, mutx = np.zeros((size, nodes)), np.zeros((size, nodes)), np.zeros(size)
        any_mutation = -np.expm1(zero - ln)
        for c, x in each.items():
            dnp[:, c] = x.sum((1, 2)) / ones
            # Ties: the smallest child genotype, then the smallest row.
            flat = x.transpose(0, 2, 1).reshape(size, -1)
            at = flat.argmax(1)
            value = flat[np.arange(size), at]
            better = value > best
            best, dnl = np.where(better, value, best), np.where(better, c, dnl).astype(np.int32)
            row, col = np.where(better, at % x.shape[1], row).astype(np.int32), np.where(better, at // x.shape[1], col).astype(np.int32)
            y, z = q.joint(c, "full", "mean", up)
            mutx += y.sum((1, 2)) / z
            y, z = q.joint(c, "full", "none", up)
            mutp[:, c] = (1 - y.sum((1, 2)) / z) / any_mutation
        out |= {"mutx": mutx, "dnq": _rounded_phred_of_rest(best / ones, 255), "dnl": dnl, "dnt_row": row, "dnt_col": col, "mutp": mutp, "node_dnp": dnp}
    post = []
    for v in range(nodes):
        x = q._product(v, None, local, down)
        post.append(x / x.sum(1, keepdims=True))
    out["post"] = post
    out["gt"] = np.stack([x.argmax(1) for x in post], 1).astype(np.int32)
    out["gq"] = np.stack([_rounded_phred_of_rest(x.max(1), 255) for x in post], 1)
    out["pl"] = [np.minimum(4095, np.rint(to_phred * np.log(np.maximum(lik[i], 1e-300)))).astype(np.int32) for i in libs]
    return out


def genotype_text(g: int, ploidy: int, alleles: list[str]) -> str:
    if ploidy == 1:
        return alleles[g]
    b, a = M.pairs(len(alleles))[g]
    return f"{alleles[b]}/{alleles[a]}"


def mutation_text(graph: Graph, node: int, row: int, col: int, alleles: list[str]) -> str:
    """`dad*mom->child` or `parent->child` of the likeliest single mutation."""
    v, nodes = graph.nodes[node], graph.nodes
    ups = [p for p, _, _ in sorted(v.ups, key=lambda u: u[2] == "mom")]
    if len(ups) == 2:
        width = len(alleles) * (len(alleles) + 1) // 2 if nodes[ups[1]].ploidy == 2 else len(alleles)
        left = f"{genotype_text(row // width, nodes[ups[0]].ploidy, alleles)}*{genotype_text(row % width, nodes[ups[1]].ploidy, alleles)}"
    else:
        left = genotype_text(row, nodes[ups[0]].ploidy, alleles)
    return f"{left}->{genotype_text(col, v.ploidy, alleles)}"
