"""DuckDB twins of the span operators."""

from __future__ import annotations

from .pii import BASE, IDNO, LEAST, NEAR, POINTS
from .secrets import BASE as SECRET_BASE
from .secrets import ORDER_RATE, RATE

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_PII = {
    "email": _EMAIL,
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "idno": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def placed_sql(patterns: dict[str, str], context: int) -> str:
    """CTEs up to ``s``: one row a match, with its place and surroundings."""
    quoted = {k: p.replace("'", "''") for k, p in patterns.items()}
    parts = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {i} AS rank, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS p FROM d" for i, (k, p) in enumerate(quoted.items()))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
e AS (SELECT r, kind, rank, m, p, unnest(range(1, len(m) + 1)) AS i FROM m WHERE len(m) > 0),
s AS (SELECT r, kind, rank, m[i] AS x, CAST(list_sum(list_transform(p[1:i], lambda z: length(z)))
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS start,
        right(p[i], {context}) AS before, left(p[i + 1], {context}) AS after FROM e)"""


def _pii_sql() -> str:
    ip = r"^" + r"\.".join([r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"] * 4) + "$"
    points = " ".join(f"WHEN '{k}' THEN {sure} + CASE WHEN regexp_matches(near, '{NEAR[k]}') THEN {more} ELSE 0 END" for k, (sure, more) in POINTS.items())
    names = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PII)
    return f"""{placed_sql(_PII, 40)},
n AS (
  SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS dig, replace(x, ' ', '') AS code,
         translate(before || chr(10) || after, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near FROM s),
v AS (
  SELECT *, CASE kind {points} END AS points FROM n
  WHERE CASE kind
    WHEN 'ip' THEN regexp_matches(x, '{ip}')
    WHEN 'phone' THEN length(dig) BETWEEN 10 AND 15
    WHEN 'idno' THEN regexp_matches(x, '{IDNO}')
    WHEN 'card' THEN length(dig) BETWEEN 14 AND 19 AND
      list_sum(list_transform(string_split(reverse(dig), ''), lambda c, i:
        CASE WHEN i % 2 = 0 THEN CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(c AS INT) END)) % 10 = 0
    WHEN 'iban' THEN length(code) BETWEEN 15 AND 34 AND
      list_reduce(list_prepend(0, list_transform(string_split(code[5:] || code[1:4], ''), lambda c:
        CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, b: (a * CASE WHEN b >= 10 THEN 100 ELSE 10 END + b) % 97) = 1
    ELSE true END),
g AS (
  SELECT r, {counts}, max(points) AS top,
         string_agg(kind || ':' || start || ':' || (start + length(x)), ',' ORDER BY start, rank) FILTER (kind IN ({names})) AS base,
         string_agg(kind || ':' || start || ':' || (start + length(x)), ',' ORDER BY start, rank) AS spans
  FROM v WHERE kind IN ({names}) OR points >= {LEAST} GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PII)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, CAST(coalesce(top, 0) AS BIGINT) AS top_points
FROM d LEFT JOIN g USING (r)"""


OP6_SQL = _pii_sql()


_NAMES = "|".join("".join(c if c in "_?" else f"[{c.upper()}{c}]" for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?(?:[A-Za-z0-9+/_.=-]+)"
_SECRETS = {"assign": _ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]{16,}", "random": r"[A-Za-z0-9+/=_-]{20,}"}


def _secret_sql() -> str:
    head = _ASSIGN.rpartition("(?:")[0].replace("'", "''")
    names = ", ".join(f"'{k}'" for k in SECRET_BASE)
    span = "kind || ':' || start || ':' || (start + length(x))"
    return f"""{placed_sql(_SECRETS, 0)},
a AS (
  SELECT *, CASE WHEN regexp_matches(x, '^(?:[0-9a-f]+|[0-9A-F]+)$') THEN 16 WHEN regexp_matches(x, '^[A-Z2-7]+$') THEN 32
                 WHEN regexp_matches(x, '^[0-9a-z]+$') THEN 36 ELSE 64 END AS a FROM s WHERE kind = 'random'),
c AS (
  SELECT r, start, x, CAST(a AS DOUBLE) AS a, CASE WHEN a = 16 THEN 0.1::DOUBLE ELSE 0.066::DOUBLE END AS ic,
         CASE WHEN a = 16 THEN 0.005::DOUBLE ELSE 0.001::DOUBLE END AS sp, CAST(length(x) AS DOUBLE) AS n,
         list_transform(list_transform(string_split(x, ''), lambda h: ascii(h)), lambda h: CASE
           WHEN a = 16 THEN CASE WHEN h <= 57 THEN h - 48 WHEN h <= 90 THEN h - 55 ELSE h - 87 END
           WHEN a = 32 THEN CASE WHEN h >= 65 THEN h - 65 ELSE h - 24 END
           WHEN a = 36 THEN CASE WHEN h <= 57 THEN h - 48 ELSE h - 87 END
           WHEN h BETWEEN 65 AND 90 THEN h - 65 WHEN h BETWEEN 97 AND 122 THEN h - 71 WHEN h BETWEEN 48 AND 57 THEN h + 4
           WHEN h IN (43, 45) THEN 62 ELSE 63 END) AS c FROM a),
q AS (
  SELECT *, CAST(list_sum(list_transform(range(0, CAST(a AS BIGINT)), lambda k: pow(len(list_filter(c, lambda v: v = k)), 2))) AS DOUBLE) AS squares,
         CAST(len(list_filter(c, lambda v: v * 2 >= a)) AS DOUBLE) AS high,
         CAST(len(list_filter(range(1, len(c)), lambda i: (c[i] * 2 >= a) <> (c[i + 1] * 2 >= a))) + 1 AS DOUBLE) AS runs,
         CAST(list_sum(c) AS DOUBLE) AS total, CAST(list_sum(list_transform(c, lambda v: v * v)) AS DOUBLE) AS power,
         CAST(list_sum(list_transform(range(1, len(c)), lambda i: c[i] * c[i + 1])) AS DOUBLE) AS products, CAST(c[1] + c[-1] AS DOUBLE) AS ends FROM c),
z AS (
  SELECT r, start, x, n, (a / n * squares - n - (n * (a * ic - 1.0::DOUBLE) + a - 1.0::DOUBLE)) / sqrt(4.0::DOUBLE * n * a * a * sp + 2.0::DOUBLE * (a - 1.0::DOUBLE)) AS z,
         2.0::DOUBLE * high * (n - high) AS b, runs, total / n AS mean, total, power, products, ends FROM q),
y AS (
  SELECT r, start, x, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(1.5976::DOUBLE * z + 0.070565::DOUBLE * z * z * z))) AS p,
         CASE WHEN b * (b - n) > 0 THEN (runs - b / n - 1.0::DOUBLE) / sqrt(b * (b - n) / (n * n * (n - 1.0::DOUBLE))) ELSE 99.0::DOUBLE END AS zr,
         CASE WHEN power - n * mean * mean > 0 THEN (products - mean * (2.0::DOUBLE * total - ends) + (n - 1.0::DOUBLE) * mean * mean)
              / (power - n * mean * mean) * sqrt(n) ELSE 99.0::DOUBLE END AS zs FROM z),
t AS (SELECT r, start, x, p, 2.0::DOUBLE / (1.0::DOUBLE + exp(1.5976::DOUBLE * abs(zr) + 0.070565::DOUBLE * abs(zr) * abs(zr) * abs(zr))) AS qr,
        2.0::DOUBLE / (1.0::DOUBLE + exp(1.5976::DOUBLE * abs(zs) + 0.070565::DOUBLE * abs(zs) * abs(zs) * abs(zs))) AS qs FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p) AS i, count(*) OVER (PARTITION BY r) AS m FROM t),
cut AS (SELECT r, max(p) AS cut FROM k WHERE p <= CAST(i AS DOUBLE) * {RATE}::DOUBLE / CAST(m AS DOUBLE) GROUP BY r),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY q) AS i, count(*) OVER (PARTITION BY r) AS m FROM (SELECT r, qr AS q FROM t UNION ALL SELECT r, qs FROM t)),
orderly AS (SELECT r, max(q) AS odd FROM o WHERE q <= CAST(i AS DOUBLE) * {ORDER_RATE}::DOUBLE / CAST(m AS DOUBLE) GROUP BY r),
v AS (
  SELECT r, kind, rank, start, x FROM s WHERE CASE kind
    WHEN 'assign' THEN length(regexp_replace(x, '^{head}', '')) >= 12 WHEN 'access' THEN length(x) >= 18 WHEN 'hex' THEN true ELSE false END
  UNION ALL
  SELECT r, 'random', 3, start, x FROM t JOIN cut USING (r) LEFT JOIN orderly USING (r)
    WHERE p <= cut AND qr > coalesce(odd, -1.0::DOUBLE) AND qs > coalesce(odd, -1.0::DOUBLE)),
g AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _SECRETS)},
         string_agg({span}, ',' ORDER BY start, rank) FILTER (kind IN ({names})) AS base, string_agg({span}, ',' ORDER BY start, rank) AS spans
  FROM v GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _SECRETS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""


OP9_SQL = _secret_sql()
