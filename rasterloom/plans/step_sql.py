"""SQL of the step-day searches: normal sums by windows over days, then elimination of a seven-term system in plain columns.

Days are centred and scaled, which changes neither the step nor the curve; the system is eliminated in the order of its terms, the step last, so
that its last pivot is the reciprocal of the step's variance.
"""

from __future__ import annotations

TERMS = 7
_BASE = ("1::DOUBLE", "kv", "kg", "t", "t * t", "t * t * t")


def _upper(size: int = TERMS):
    return [(i, j) for i in range(size) for j in range(i, size)]


def solved(kernels: str, bands: str, columns: str, refl: str, buffer: int = 30) -> str:
    """CTEs up to steps(pixel, band, dos, pre, post, step, unc, rmse) of every candidate day.

    kernels are CTEs up to k(pixel, doy, refl, kv, kg); bands rows of columns (band, ...); refl the reflectance of a band.
    """
    sums = ", ".join([f"sum(({_BASE[i]}) * ({_BASE[j]})) AS m{i}{j}" for i, j in _upper(TERMS - 1)] + [f"sum(({_BASE[i]}) * y) AS v{i}" for i in range(TERMS - 1)])
    after = "OVER (PARTITION BY pixel, band ORDER BY doy DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = "OVER (PARTITION BY pixel, band)"
    matrix = ", ".join([f"sum(m{i}{j}) {whole} AS m{i}{j}" for i, j in _upper(TERMS - 1)] + [f"coalesce(sum(m0{i}) {after}, 0) AS m{i}6" for i in range(TERMS - 1)]
                       + [f"coalesce(sum(m00) {after}, 0) AS m66", f"coalesce(sum(v0) {after}, 0) AS v6"] + [f"sum(v{i}) {whole} AS v{i}" for i in range(TERMS - 1)])
    ctes = [
        kernels, f"rec AS (SELECT pixel, b.band, doy, (doy - 183) / 183::DOUBLE AS t, kv, kg, {refl} AS y FROM k, (VALUES {bands}) b({columns}))",
        f"daily AS (SELECT pixel, band, doy, {sums}, sum(y * y) AS yy, count(*) AS n FROM rec GROUP BY 1, 2, 3)",
        f"sums AS (SELECT pixel, band, doy AS dos, {matrix}, sum(yy) {whole} AS yy, sum(n) {whole} AS n FROM daily)",
        "ends AS (SELECT pixel, min(doy) AS d0, max(doy) AS d1 FROM rec GROUP BY 1)",
        f"e0 AS (SELECT s.*, {', '.join(f'm{i}{i} AS q{i}' for i in range(TERMS))} FROM sums s JOIN ends USING (pixel) WHERE dos BETWEEN d0 + {buffer} AND d1 - {buffer})"]
    for k in range(TERMS - 1):
        rest = [f"m{i}{j} - m{k}{i} * m{k}{j} / nullif(m{k}{k}, 0) AS m{i}{j}" for i, j in _upper() if i > k] + [f"v{i} - m{k}{i} * v{k} / nullif(m{k}{k}, 0) AS v{i}" for i in range(k + 1, TERMS)]
        ctes.append(f"e{k + 1} AS (SELECT * REPLACE ({', '.join(rest)}) FROM e{k})")
    last = f"e{TERMS - 1}"
    regular = " AND ".join(f"m{k}{k} > 1e-12 * q{k}" for k in range(TERMS))
    ctes.append(f"p6 AS (SELECT *, v6 / m66 AS p6 FROM {last} WHERE {regular})")
    for k in range(TERMS - 2, -1, -1):
        known = " ".join(f"- m{k}{j} * p{j}" for j in range(k + 1, TERMS))
        ctes.append(f"p{k} AS (SELECT *, (v{k} {known}) / m{k}{k} AS p{k} FROM p{k + 1})")
    curve = lambda t: f"(p0 + ({t}) * (p3 + ({t}) * (p4 + ({t}) * p5)))"
    sse = "yy " + " ".join(f"- v{k} * v{k} / m{k}{k}" for k in range(TERMS))
    ctes.append(f"""steps AS (SELECT pixel, band, dos, {curve('(dos - 183) / 183::DOUBLE')} AS pre, {curve('(dos - 182) / 183::DOUBLE')} + p6 AS post, p6 AS step, 1 / sqrt(m66) AS unc,
        sqrt(greatest({sse}, 0) / n) AS rmse FROM p0)""")
    return ",\n    ".join(ctes)


def per_day(bands: list[int], noise: tuple[float, ...]) -> str:
    """per(pixel, dos, rmse, s<k>, d<k>): the bands of a day side by side, days with all of them."""
    columns = ", ".join(f"max(step / (unc * {u})) FILTER (band = {b}) AS s{k}, max(step) FILTER (band = {b}) AS d{k}" for k, (b, u) in enumerate(zip(bands, noise, strict=True)))
    return f"per AS (SELECT pixel, dos, sqrt(avg(rmse * rmse)) AS rmse, {columns} FROM steps GROUP BY 1, 2 HAVING count(*) = {len(bands)})"


def mixture(shape: dict[int, float]) -> str:
    """mix(pixel, dos, fcc, a0, a1): the spectral mixture of the steps over the bands; shape holds the burnt spectrum's form."""
    top = max(shape.values())
    form = "CASE band " + " ".join(f"WHEN {b} THEN {v / top!r}::DOUBLE" for b, v in shape.items()) + " END"
    return f"""mixed AS (SELECT pixel, dos, count(*)::DOUBLE AS a, sum(l) AS b, sum(g) AS c, sum(l * l) AS d, sum(l * g) AS e, sum(g * g) AS f, sum(w) AS x, sum(w * l) AS y, sum(w * g) AS z
      FROM (SELECT pixel, dos, {form} AS l, pre AS g, post - pre AS w FROM steps) GROUP BY 1, 2),
    det AS (SELECT *, nullif(a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c), 0) AS det FROM mixed),
    roots AS (SELECT pixel, dos, (x * (d * f - e * e) - b * (y * f - e * z) + c * (y * e - d * z)) / det AS r0, (a * (y * f - e * z) - x * (b * f - e * c) + c * (b * z - y * c)) / det AS r1,
      (a * (d * z - y * e) - b * (b * z - y * c) + x * (b * e - d * c)) / det AS r2 FROM det),
    mix AS (SELECT pixel, dos, -r2 AS fcc, r0 / nullif(-r2, 0) AS a0, r1 / nullif(-r2, 0) AS a1 FROM roots)"""
