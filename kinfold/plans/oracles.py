"""SQL that derives priors, transitions and configurations from the model's constants alone, without the library's code."""

from __future__ import annotations

#: Of the defaults: mutation rate, diversity, alleles; read error and its alleles, overdispersion.
CONSTANTS = "c AS (SELECT CAST(1e-8 AS DOUBLE) AS u, CAST(0.001 AS DOUBLE) / 4 AS e, CAST(5 AS DOUBLE) AS k, CAST(0.9995 AS DOUBLE) AS y, CAST(0.0005 AS DOUBLE) / 3 AS n, CAST(0.9995 AS DOUBLE) / 0.0005 AS a)"
#: Of two alleles seen: chances along a branch in all, without and with just one mutation, and with the number of mutations; of an allele from a genotype; of the founders.
MODEL = f"""{CONSTANTS},
step AS (SELECT i.i AS i, j.j AS j,
    CASE WHEN i.i = j.j THEN 1 - (k - 1) * off ELSE off END AS p_all,
    CASE WHEN i.i = j.j THEN exp(-u) ELSE 0 END AS p_none,
    CASE WHEN i.i = j.j THEN 0 ELSE exp(-u) * u / (k - 1) END AS p_one,
    CASE WHEN i.i = j.j THEN u * (1 - exp(-u * k / (k - 1))) / k ELSE u * (1 + exp(-u * k / (k - 1)) / (k - 1)) / k END AS p_mean
  FROM (SELECT *, (u * k / (k - 1) - pow(u * k / (k - 1), 2) / 2) / k AS off FROM c), range(2) i(i), range(2) j(j)),
g(g, b, a) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1)),
gamete AS (SELECT g, j, avg(p_all) AS p_all, avg(p_none) AS p_none, avg(p_one) AS p_one, avg(p_mean) AS p_mean
  FROM (SELECT g, a AS i FROM g UNION ALL SELECT g, b FROM g) JOIN step USING (i) GROUP BY g, j),
founder AS (SELECT g, CASE g WHEN 0 THEN (1 + e) / (1 + k * e) * (2 + e) / (2 + k * e) WHEN 1 THEN e / (1 + k * e) * (2 + 2 * e) / (2 + k * e) ELSE (1 + e) / (1 + k * e) * e / (2 + k * e) END AS p FROM c, range(3) r(g)),
hemi AS (SELECT i AS g, CASE i WHEN 0 THEN (1 + e) / (1 + k * e) ELSE e / (1 + k * e) END AS p FROM c, range(2) r(i))"""


def _children(dad: str, dads: str) -> str:
    """Weights of (dad, mom, child); dad: chances of the allele that he passes on; dads: of his genotypes."""
    pair = lambda x, y: f"sum(d.{x} * m.{y})"
    return f"""pairs AS (SELECT d.g AS d, m.g AS m, least(d.j, m.j) + greatest(d.j, m.j) AS c, {pair('p_all', 'p_all')} AS p_all, {pair('p_none', 'p_none')} AS p_none,
  {pair('p_one', 'p_none')} + {pair('p_none', 'p_one')} AS p_one, {pair('p_mean', 'p_all')} + {pair('p_all', 'p_mean')} AS p_mean FROM {dad} d, gamete m GROUP BY 1, 2, 3),
w AS (SELECT d, m, c, p_all * x.p * y.p AS p_all, p_none * x.p * y.p AS p_none, p_one * x.p * y.p AS p_one, p_mean * x.p * y.p AS p_mean FROM pairs JOIN {dads} x ON x.g = d JOIN founder y ON y.g = m)"""


def _reads(who: str, haploid: bool = False) -> str:
    """ln of the chance of a library's reads (reference, other) by genotype; {who}_top: the largest."""
    r, v = f"{who}_ref", f"{who}_alt"
    rise = lambda a, n: f"(lgamma({a} + {n}) - lgamma({a}))"
    hom, het = f"{rise('a', f'({r} + {v})')}", f"{rise('a', f'({r} + {v})')}"
    terms = [f"{rise('a * y', r)} + {rise('a * n', v)} - {hom}", f"{rise('a * (y + n) / 2', r)} + {rise('a * (y + n) / 2', v)} - {het}", f"{rise('a * n', r)} + {rise('a * y', v)} - {hom}"]
    own = [terms[0], terms[2]] if haploid else terms
    return ", ".join(f"{t} AS {who}{i}" for i, t in enumerate(own))


def likelihoods(with_f: str, depths: str, ploidy: int) -> str:
    return f"{with_f}, {CONSTANTS}, d AS ({depths}), l AS (SELECT site, {_reads('child', ploidy == 1)} FROM d, c) SELECT site, " + ", ".join(f"round(child{i}, 5) AS ll{i}" for i in range(3 if ploidy == 2 else 2)) + " FROM l"


_KINDS = (("p_all", (("p_all", "p_all"),)), ("p_none", (("p_none", "p_none"),)), ("p_one", (("p_one", "p_none"), ("p_none", "p_one"))), ("p_mean", (("p_mean", "p_all"), ("p_all", "p_mean"))))


def _grandchildren() -> str:
    """Weights of (grandfather, mother, child), the grandmother and the father summed over."""
    older = ", ".join(f"sum(x.p * {k}) AS {k}" for k, _ in _KINDS)
    both = ", ".join(f"sum(fd.p * fm.p * ({' + '.join(f'o.{a} * y.{b}' for a, b in terms)})) AS {k}" for k, terms in _KINDS)
    return f"""older AS (SELECT p.d AS g, p.c AS f, {older} FROM pairs p JOIN founder x ON x.g = p.m GROUP BY 1, 2),
three AS (SELECT o.g AS d, y.m AS m, y.c AS c, {both} FROM older o JOIN pairs y ON y.d = o.f JOIN founder fd ON fd.g = o.g JOIN founder fm ON fm.g = y.m GROUP BY 1, 2, 3)"""


def tree(depths: str, reads: str, told: str, mu: float = 20.0, het: float = 30.0) -> str:
    """Of the three libraries as leaves of ((dad, child), mom): `t` with the chances none, one and every of no, one and any mutations. told: what is selected."""
    u = f"pow(10, -{mu} / 10)"
    v = f"(1 - {u})"
    m = [[f"{v} * {v}", f"2 * {u} * {v}", f"{u} * {u}"], [f"{v} * {u}", f"({u} * {u} + {v} * {v})", f"{v} * {u}"], [f"{u} * {u}", f"2 * {u} * {v}", f"{v} * {v}"]]
    p = lambda w: [f"pow(10, -2 * {w}_alt)", f"pow(10, -0.3 * ({w}_ref + {w}_alt))", f"pow(10, -2 * {w}_ref)"]
    x, y, z = (f"x{k}" for k in range(3)), (f"y{k}" for k in range(3)), (f"z{k}" for k in range(3))
    x, y, z = list(x), list(y), list(z)
    prior = [f"1 / (2 + pow(10, -{het} / 10))", f"pow(10, -{het} / 10) / (2 + pow(10, -{het} / 10))", f"1 / (2 + pow(10, -{het} / 10))"]
    up = lambda leaf, g: "(" + " + ".join(f"{m[k][g]} * {leaf[k]}" for k in range(3)) + ")"
    turned = lambda leaf, g: "(" + " + ".join(f"{m[k][g]} * {leaf[k]}" for k in range(3) if k != g) + ")"
    stay = lambda g, n: " * ".join([m[g][g]] * n)
    none = " + ".join(f"{prior[g]} * {stay(g, 4)} * {x[g]} * {y[g]} * {z[g]}" for g in range(3))
    one = " + ".join(
        f"{prior[g]} * ({stay(g, 3)} * ({turned(x, g)} * {y[g]} * {z[g]} + {x[g]} * {turned(y, g)} * {z[g]} + {x[g]} * {y[g]} * {turned(z, g)}) + "
        + f"{stay(g, 1)} * {z[g]} * (" + " + ".join(f"{m[a][g]} * {stay(a, 2)} * {x[a]} * {y[a]}" for a in range(3) if a != g) + "))"
        for g in range(3)
    )
    every = " + ".join(f"{prior[g]} * {up(z, g)} * (" + " + ".join(f"{m[a][g]} * {up(x, a)} * {up(y, a)}" for a in range(3)) + ")" for g in range(3))
    leaves = ", ".join(f"{e} AS {n}" for w, names in (("dad", x), ("child", y), ("mom", z)) for e, n in zip(p(w), names, strict=True))
    return f"WITH {reads}, d AS ({depths}), l AS (SELECT site, {leaves} FROM d), t AS (SELECT site, {none} AS none, {one} AS one, {every} AS every FROM l) {told}"


def rank_test(reads: str, value: str) -> str:
    """(site, t): Anderson and Darling's two-sample statistic of the reference's and other reads' values, with midranks, standardised as by Scholz and Stephens."""
    harmonic = lambda n: f"list_sum(list_transform(range(1, {n} + 1), lambda i: 1.0 / i))"
    w = "OVER (PARTITION BY site ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""(WITH {reads}, s AS (SELECT site, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base = ref_base THEN 1 ELSE 0 END) AS DOUBLE) AS n1, CAST(sum(CASE WHEN base <> ref_base THEN 1 ELSE 0 END) AS DOUBLE) AS n2 FROM f GROUP BY site),
  v AS (SELECT site, {value} AS v, CAST(count(*) AS DOUBLE) AS l, sum(CASE WHEN base = ref_base THEN 1 ELSE 0 END) AS f1, sum(CASE WHEN base <> ref_base THEN 1 ELSE 0 END) AS f2 FROM f GROUP BY site, v),
  b AS (SELECT site, l, coalesce(sum(l) {w}, 0) + l / 2 AS b, coalesce(sum(f1) {w}, 0) + f1 / 2.0 AS m1, coalesce(sum(f2) {w}, 0) + f2 / 2.0 AS m2 FROM v),
  a AS (SELECT site, any_value(n) AS n, any_value(n1) AS n1, any_value(n2) AS n2,
      coalesce(sum(CASE WHEN b * (n - b) - n * l / 4 > 0 THEN l / n * (pow(n * m1 - n1 * b, 2) / n1 + pow(n * m2 - n2 * b, 2) / n2) / (b * (n - b) - n * l / 4) END), 0) * (any_value(n) - 1) / any_value(n) AS a2
    FROM b JOIN s USING (site) WHERE n1 > 0 AND n2 > 0 AND n >= 4 GROUP BY site),
  h AS (SELECT *, 1 / n1 + 1 / n2 AS hh, {harmonic('CAST(n AS BIGINT) - 1')} AS h, list_sum(list_transform(range(1, CAST(n AS BIGINT) - 1), lambda k: list_sum(list_transform(range(k + 1, CAST(n AS BIGINT)), lambda j: 1.0 / j)) / (n - k))) AS g FROM a),
  c AS (SELECT *, (4 * g - 6) + (10 - 6 * g) * hh AS ca, (2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * hh - 8 * h + 4 * g - 6 AS cb, (6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * hh + 4 * h AS cc, (2 * h + 6) * 4 - 8 * h AS cd FROM h)
  SELECT site, (a2 - 1) / sqrt((ca * n * n * n + cb * n * n + cc * n + cd) / ((n - 1) * (n - 2) * (n - 3))) AS t FROM c)"""


def trio(reads: str, depths: str, x_linked: bool = False, generations: int = 2) -> str:
    """`z`: a row a site and genotypes; `t`: a row a site with qual, mutq, mutx, lld, lls, llh, dnp, dp. reads: a CTE of filtered reads, f; depths: of the three libraries."""
    n = {"dad": 2 if x_linked else 3, "child": 3, "mom": 3}
    top = {w: f"greatest({', '.join(f'{w}{i}' for i in range(k))})" for w, k in n.items()}
    pick = lambda w, g: f"CASE {g} {' '.join(f'WHEN {i} THEN {w}{i}' for i in range(n[w]))} END - {top[w]}"
    model = MODEL + ",\n" + _children("(SELECT i AS g, j, p_all, p_none, p_one, p_mean FROM step)" if x_linked else "gamete", "hemi" if x_linked else "founder")
    if generations == 3:
        model += ",\n" + _grandchildren()
    xlog = lambda x: f"CASE WHEN {x} > 0 THEN ({x}) * log10({x}) ELSE 0 END"
    ref, alt = ("(" + " + ".join(f"{w}_{k}" for w in n) + ")" for k in ("ref", "alt"))
    # One allele only, if no read had another
    alone = "(SELECT h.p * f.p * s.p_all * s.p_all FROM hemi h, founder f, step s WHERE h.g = 0 AND f.g = 0 AND s.i = 0 AND s.j = 0)" if x_linked else "(SELECT f.p * f.p * s.p_all * s.p_all FROM founder f, step s WHERE f.g = 0 AND s.i = 0 AND s.j = 0)"
    return f"""WITH {reads}, {model}, d AS ({depths}),
l AS (SELECT d.*, {', '.join(_reads(w, k == 2) for w, k in n.items())} FROM d, c),
z AS (SELECT l.*, w.*, exp({pick('dad', 'w.d')} + {pick('mom', 'w.m')} + {pick('child', 'w.c')}) AS ex, {' + '.join(top.values())} AS tops FROM l, {'three' if generations == 3 else 'w'} w),
s AS (SELECT site, any_value({ref}) AS r, any_value({alt}) AS v, sum(w.p_all * ex) AS p, sum(w.p_none * ex) AS p0, sum(w.p_one * ex) AS p1, sum(w.p_mean * ex) AS pm, any_value(tops) AS top,
    sum(CASE WHEN w.d = 0 AND w.m = 0 AND w.c = 0 THEN ex END) AS mono
  FROM z w GROUP BY site),
t AS (SELECT site, CAST(r + v AS BIGINT) AS dp, -10 * log10({alone} * mono / p) AS qual, -10 * log10(p0 / p) AS mutq, pm / p AS mutx, (ln(p) + top) / ln(10) AS lld, (ln(p) + top) / ln(10) - ({xlog('r')} + {xlog('v')} - ({xlog('r + v')})) AS lls,
    ln(p) / ln(10) AS llh, p1 / p AS dnp FROM s)"""


_PL = {"child": 0, "mom": 10, "dad": 20}


def pl_sum(who: tuple[str, ...]) -> str:
    return " + ".join(f"floor(abs(CAST(embedding[{_PL[w] + 1} + {w}] AS DOUBLE)) * 100)" for w in who)


_FROM = "FROM embeddings JOIN w ON {on} WHERE embedding IS NOT NULL AND len(embedding) >= 30"
#: Genotypes by number, with their two letters.
_GENOTYPES = "gt AS (SELECT row_number() OVER () - 1 AS g, t, t[1] AS x, t[2] AS y FROM (SELECT unnest(['AA', 'AC', 'AG', 'AT', 'CC', 'CG', 'CT', 'GG', 'GT', 'TT']) AS t))"


def snp(model: str, found: float | None = None) -> str:
    """Mendel's rules for trios of genotypes; XS: a son's X, XD: a daughter's. found: cutoff of the posterior."""
    refuse = {"auto": "false", "XS": "n > 2 OR hd OR hc", "XD": "n > 2 OR hd"}[model]
    rules = f"""CASE WHEN {refuse} THEN 0 WHEN n = 4 THEN 0
      WHEN n = 3 THEN CASE WHEN mendel THEN CASE WHEN NOT hc OR share = 0.25 THEN 0.25 ELSE 0.5 END ELSE 1 END
      WHEN fresh THEN 1 WHEN in_m AND in_d THEN CASE WHEN hc THEN greatest(share, 0.5) ELSE share END ELSE 1 END"""
    hits = f"""CASE WHEN n = 4 THEN 0 WHEN n = 3 THEN CASE WHEN mendel THEN 0 WHEN apart THEN 2 ELSE 1 END
      WHEN fresh THEN CASE WHEN hc THEN 1 WHEN {str(model == "XS").lower()} THEN 1 ELSE 2 END WHEN in_m AND in_d THEN 0
      WHEN in_m AND {str(model == "XS").lower()} THEN 0 ELSE 1 END"""
    prior = """CASE WHEN n > 3 THEN 1e-26 WHEN kinds = 3 OR (n < 3 AND hits = 0 AND kinds = 2) THEN 0.002 * 0.002 / 414 WHEN n = 3 THEN 1e-6
      WHEN hits = 4 THEN 0.995 * 0.998 ELSE 0.995 * 0.002 * CASE hits WHEN 2 THEN CASE WHEN hm OR hd THEN 0.16 ELSE 0.04 END WHEN 0 THEN 0.12 WHEN 3 THEN 0.24 ELSE 0.08 END END"""
    had = "contains(m.t || d.t, c.x) AND contains(m.t || d.t, c.y)"
    lone = lambda who: f"(contains({who}.t, c.x) OR contains({who}.t, c.y))"
    where = "" if found is None else f" HAVING max(CASE WHEN denovo THEN v ELSE 0 END) / sum(v) > {found}"
    return f"""WITH {_GENOTYPES}, trio AS (SELECT c.g AS child, m.g AS mom, d.g AS dad, m.t || d.t AS parents, c.x <> c.y AS hc, m.x <> m.y AS hm, d.x <> d.y AS hd,
    pow(0.5, (m.x <> m.y)::INT + (d.x <> d.y)::INT) AS share, len(list_distinct(string_split(c.t || m.t || d.t, ''))) AS n, len(list_distinct(string_split(m.t || d.t, ''))) AS kinds,
    (contains(d.t, c.x) AND contains(m.t, c.y)) OR (contains(m.t, c.x) AND contains(d.t, c.y)) AS mendel, NOT contains(m.t || d.t, c.x) AND NOT contains(m.t || d.t, c.y) AS apart,
    NOT ({had}) AS fresh, {lone('m')} AS in_m, {lone('d')} AS in_d FROM gt c, gt m, gt d),
rule AS (SELECT *, {rules} AS passed, {hits} AS mutations FROM trio),
w AS (SELECT ref, child, mom, dad, passed * CASE mutations WHEN 0 THEN 1 - 1e-8 WHEN 1 THEN 1e-8 ELSE 1e-16 END * {'1' if model == 'auto' else '0.75'} * {prior} AS weight, mutations > 0 AS denovo
  FROM (SELECT rule.*, ref, len(parents) - len(replace(parents, ref, '')) AS hits FROM rule, (SELECT unnest(['A', 'C', 'G', 'T']) AS ref))),
x AS (SELECT vec_id, denovo, weight * pow(10, -({pl_sum(('child', 'mom', 'dad'))}) / 10) AS v {_FROM.format(on="substr('ACGT', CAST(vec_id % 4 + 1 AS INT), 1) = ref AND weight > 0")})
SELECT vec_id, round(log10(max(CASE WHEN denovo THEN v ELSE 0 END) / sum(v)), 4) AS pp, round(log10(max(CASE WHEN denovo THEN 0 ELSE v END)), 4) AS null_like FROM x GROUP BY vec_id{where}"""


# The published table of indel trios (child/mom/dad, chance of transmission, prior; two mutations make DD of RR and RR of DD).
INDELS = """
RR/RR/RR 1 0.05    RR/RD/RR 0.5 0.228  RR/DD/RR 0 0.038
RD/RR/RR 1 0.05    RD/RD/RR 0.5 0.228  RD/DD/RR 1 0.038
DD/RR/RR 1 0.05    DD/RD/RR 0 0.228    DD/DD/RR 0 0.038
RR/RR/RD 0.5 0.228 RR/RD/RD 0.25 0.152 RR/DD/RD 0 0.076
RD/RR/RD 0.5 0.228 RD/RD/RD 0.5 0.152  RD/DD/RD 0.5 0.076
DD/RR/RD 0 0.228   DD/RD/RD 0.25 0.152 DD/DD/RD 0.5 0.076
RR/RR/DD 0 0.038   RR/RD/DD 0 0.076    RR/DD/DD 1 0.114
RD/RR/DD 1 0.038   RD/RD/DD 0.5 0.076  RD/DD/DD 1 0.114
DD/RR/DD 0 0.038   DD/RD/DD 0.5 0.076  DD/DD/DD 1 0.114
""".split()


def indel() -> str:
    place = {"RR": 0, "RD": 1, "DD": 2}
    rows = []
    for name, passed, prior in zip(INDELS[::3], INDELS[1::3], INDELS[2::3], strict=True):
        child, mom, dad = name.split("/")
        hits = {("RD", "RR", "RR"): 1, ("DD", "RR", "RR"): 2, ("RR", "DD", "DD"): 2, ("RD", "DD", "DD"): 1}.get((child, mom, dad), 0)
        rows.append(f"({place[child]}, {place[mom]}, {place[dad]}, CAST({passed} AS DOUBLE), CAST({prior} AS DOUBLE), {hits})")
    return f"""WITH t(child, mom, dad, passed, prior, hits) AS (VALUES {', '.join(rows)}), w AS (SELECT *, passed * prior * pow(CAST(1e-9 AS DOUBLE), hits) AS weight, hits > 0 AS denovo FROM t),
x AS (SELECT vec_id, denovo, weight * pow(10, -({pl_sum(('child', 'mom', 'dad'))}) / 10) AS v {_FROM.format(on='true')})
SELECT vec_id, round(log10(max(CASE WHEN denovo THEN v ELSE 0 END) / sum(v)), 4) AS pp, round(log10(max(CASE WHEN denovo THEN 0 ELSE v END)), 4) AS null_like FROM x GROUP BY vec_id"""


def pair() -> str:
    """A rate for each allele of the tumor that the normal hasn't (1 less the rate where there is none)."""
    common = "CASE WHEN n.t = u.t THEN 2 WHEN n.x IN (u.x, u.y) OR n.y IN (u.x, u.y) THEN 1 ELSE 0 END"
    return f"""WITH {_GENOTYPES}, w AS (SELECT u.g AS child, n.g AS mom, CASE {common} WHEN 2 THEN 1 - CAST(1e-9 AS DOUBLE) WHEN 1 THEN CAST(1e-9 AS DOUBLE) ELSE CAST(1e-18 AS DOUBLE) END AS weight, n.t <> u.t AS denovo FROM gt n, gt u),
x AS (SELECT vec_id, denovo, weight * pow(10, -({pl_sum(('child', 'mom'))}) / 10) AS v {_FROM.format(on='true')})
SELECT vec_id, round(max(CASE WHEN denovo THEN v ELSE 0 END) / sum(v), 6) AS pp, round(max(CASE WHEN denovo THEN 0 ELSE v END), 6) AS null_like FROM x GROUP BY vec_id"""
