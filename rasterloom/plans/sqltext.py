"""SQL text of the pixel operators, for engines that read the same tables. Each function wraps a query text."""

from __future__ import annotations

from rasterloom.functions.sizing import box_radius


def clip01(e: str) -> str:
    return f"GREATEST(0e0, LEAST(1e0, {e}))"


LUMA = "(0.299e0 * r + 0.587e0 * g + 0.114e0 * b)"


def replace(q: str, cols: dict[str, str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in cols.items())}) FROM ({q})"


def add(q: str, cols: dict[str, str]) -> str:
    return f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM ({q})"


def drop(q: str, cols: list[str]) -> str:
    return f"SELECT * EXCLUDE ({', '.join(cols)}) FROM ({q})"


def box(q: str, cols: list[str], radius: int, passes: int = 1) -> str:
    for _ in range(passes if radius >= 1 else 0):
        for along, across, size in (("y", "x", "h"), ("x", "y", "w")):
            line = f"PARTITION BY image_id, {across} ORDER BY {along} ROWS BETWEEN"
            r = f"CAST(LEAST({radius}, {size} - 1) AS DOUBLE)"
            every = "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
            q = replace(
                q,
                {
                    c: f"(SUM({c}) OVER ({line} {radius} PRECEDING AND {radius} FOLLOWING)"
                    f" + GREATEST(0e0, {r} - {along}) * FIRST_VALUE({c}) OVER ({line} {every})"
                    f" + GREATEST(0e0, {along} + {r} - ({size} - 1)) * LAST_VALUE({c}) OVER ({line} {every})) / (2 * {r} + 1)"
                    for c in cols
                },
            )
    return q


def gauss(q: str, cols: list[str], sigma: float) -> str:
    return box(q, cols, box_radius(sigma), 3) if sigma > 0 else q


def guided(q: str, guides: list[str], sources: list[str], radius: int, eps: float) -> str:
    """Adds t0, t1, ... with the filtered sources."""
    k = range(len(guides))
    q = add(q, {n: e for i in k for n, e in ((f"i{i}", guides[i]), (f"p{i}", sources[i]), (f"ii{i}", f"{guides[i]} * {guides[i]}"), (f"ip{i}", f"{guides[i]} * {sources[i]}"))})
    names = [f"{n}{i}" for i in k for n in ("i", "p", "ii", "ip")]
    q = box(q, names, radius)
    q = add(q, {f"a{i}": f"(ip{i} - i{i} * p{i}) / (ii{i} - i{i} * i{i} + {eps!r})" for i in k})
    q = add(q, {f"b{i}": f"p{i} - a{i} * i{i}" for i in k})
    q = box(q, [f"{n}{i}" for i in k for n in "ab"], radius)
    q = add(q, {f"t{i}": f"a{i} * {guides[i]} + b{i}" for i in k})
    return drop(q, names + [f"{n}{i}" for i in k for n in "ab"])


def detail(q: str, cols: list[str], radius: int, eps: float, strength: float) -> str:
    if strength <= 0:
        return q
    q = guided(q, cols, cols, radius, eps)
    q = replace(q, {c: clip01(f"t{i} + ({c} - t{i}) * {1 + strength!r}") for i, c in enumerate(cols)})
    return drop(q, [f"t{i}" for i in range(len(cols))])


def denoise(q: str, cols: list[str], radius: float, sigma: float) -> str:
    q = guided(q, cols, cols, max(1, round(radius)), sigma * sigma + 1e-6)
    q = replace(q, {c: clip01(f"t{i}") for i, c in enumerate(cols)})
    return drop(q, [f"t{i}" for i in range(len(cols))])


def unsharp(q: str, cols: list[str], amount: float, radius: float, threshold: float) -> str:
    if amount <= 0:
        return q
    low = [f"low_{c}" for c in cols]
    q = gauss(add(q, dict(zip(low, cols, strict=True))), low, radius)
    soft = lambda c: f"({c} - low_{c}) * " + clip01(f"(ABS({c} - low_{c}) - {threshold!r}) / {threshold!r}")
    return drop(replace(q, {c: clip01(f"{c} + {1.5 * amount!r} * {soft(c)}") for c in cols}), low)


def ycbcr(q: str) -> str:
    q = add(q, {"luma": LUMA})
    return drop(add(q, {"cb": "(b - luma) * 0.564e0 + 0.5e0", "cr": "(r - luma) * 0.713e0 + 0.5e0"}), ["r", "g", "b"])


def rgb(q: str) -> str:
    q = add(q, {"r": "luma + (cr - 0.5e0) / 0.713e0", "b": "luma + (cb - 0.5e0) / 0.564e0"})
    return drop(add(q, {"g": "(luma - 0.299e0 * r - 0.114e0 * b) / 0.587e0"}), ["luma", "cb", "cr"])


def chroma_denoise(q: str, sigma: float) -> str:
    return replace(rgb(gauss(ycbcr(q), ["cb", "cr"], sigma)), {c: clip01(c) for c in "rgb"}) if sigma > 0 else q


def adjust(q: str, contrast: float, saturation: float, gamma: float) -> str:
    if gamma != 1.0:
        q = replace(q, {c: f"POW({clip01(c)}, {1 / gamma!r})" for c in "rgb"})
    if contrast != 0.0:
        q = replace(q, {c: f"{c} + ({LUMA} - 0.5e0) * {contrast!r}" for c in "rgb"})
    if saturation != 1.0:
        q = replace(q, {c: f"{LUMA} + ({c} - {LUMA}) * {saturation!r}" for c in "rgb"})
    return replace(q, {c: clip01(c) for c in "rgb"})


def levels(q: str, low: float, high: float, strength: float) -> str:
    return f"""SELECT p.* REPLACE ({', '.join(f"CASE WHEN hi - lo >= 1e-4 THEN {clip01(f'p.{c} * (1 + (1 / (hi - lo) - 1) * {strength!r}) - lo / (hi - lo) * {strength!r}')} ELSE p.{c} END AS {c}" for c in "rgb")})
FROM ({q}) p JOIN (SELECT image_id, quantile_cont({LUMA}, {low / 100!r}) AS lo, quantile_cont({LUMA}, {high / 100!r}) AS hi FROM ({q}) GROUP BY image_id) l USING (image_id)"""


def kernel(d: str, a: float = 3.0) -> str:
    x = f"(PI() * ({d}))"
    return f"CASE WHEN ABS({d}) >= {a!r} THEN 0e0 WHEN ABS({d}) < 1e-12 THEN 1e0 ELSE SIN({x}) / {x} * SIN({x} / {a!r}) / ({x} / {a!r}) END"


def _axis(q: str, keep: list[str], cols: list[str], at: str, size: str, out: str) -> str:
    """One axis by a join on the output places; out is an expression of the size in SQL."""
    rest = ", ".join(keep)
    return f"""SELECT {rest}, o AS {at}, n_out AS {size}, {', '.join(f'SUM({c} * wt) / GREATEST(SUM(wt), 1e-8) AS {c}' for c in cols)} FROM (
  SELECT *, {kernel('d')} AS wt FROM (SELECT *, (o + 0.5e0) * ({size} / CAST(n_out AS DOUBLE)) - 0.5e0 - {at} AS d FROM (
    SELECT *, CAST(UNNEST(range(GREATEST(0, CAST(FLOOR(({at} - 2.5e0) * n_out / {size} - 0.5e0) AS BIGINT)), LEAST(n_out, CAST(CEIL(({at} + 3.5e0) * n_out / {size} - 0.5e0) AS BIGINT) + 1))) AS INT) AS o
    FROM (SELECT *, CAST({out} AS INT) AS n_out FROM ({q})))) WHERE ABS(d) < 3)
GROUP BY {rest}, o, n_out"""


def resize(q: str, cols: list[str], out_w: str, out_h: str, keep: list[str] | None = None) -> str:
    keep = keep or []
    # The new width is worked out before the height changes.
    q = add(q, {"to_w": f"CAST({out_w} AS INT)"})
    q = _axis(q, ["image_id", "w", "x", "to_w", *keep], cols, "y", "h", out_h)
    return drop(_axis(q, ["image_id", "h", "y", "to_w", *keep], cols, "x", "w", "to_w"), ["to_w"])


def chained(q: str, cols: list[str], scale: float, steps: int) -> str:
    q = add(q, {"tw": f"GREATEST(1, CAST(round_even(w * {scale!r}, 0) AS INT))", "th": f"GREATEST(1, CAST(round_even(h * {scale!r}, 0) AS INT))"})
    for k in range(steps, 0, -1):
        far = "GREATEST(tw / CAST(w AS DOUBLE), th / CAST(h AS DOUBLE)) > 2.000001e0"
        ow = f"CASE WHEN {far} THEN LEAST(tw, GREATEST(w + 1, w * 2)) ELSE tw END" if k > 1 else "tw"
        oh = f"CASE WHEN {far} THEN LEAST(th, GREATEST(h + 1, h * 2)) ELSE th END" if k > 1 else "th"
        q = resize(q, cols, ow, oh, ["tw", "th"])
    return drop(q, ["tw", "th"])


def nearest(q: str, factor_w: str, factor_h: str) -> str:
    q = add(q, {"ow": factor_w, "oh": factor_h})
    q = f"SELECT * REPLACE (CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, CAST(oh AS INT) AS h, CAST(ow AS INT) AS w) FROM (SELECT *, UNNEST(range(0, CAST(ow AS BIGINT))) AS ox FROM (SELECT *, UNNEST(range(0, CAST(oh AS BIGINT))) AS oy FROM ({q}))) WHERE LEAST(CAST(FLOOR(oy * h / CAST(oh AS DOUBLE)) AS INT), h - 1) = y AND LEAST(CAST(FLOOR(ox * w / CAST(ow AS DOUBLE)) AS INT), w - 1) = x"
    return drop(q, ["ox", "oy", "ow", "oh"])


def rounded(q: str, keep: list[str], cols: list[str]) -> str:
    return f"SELECT {', '.join(keep)}, {', '.join(f'ROUND({c}, 6) + 0e0 AS {c}' for c in cols)} FROM ({q})"
