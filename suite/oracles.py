"""The same results in SQL, by brute force or from the definitions, for an independent engine."""

from __future__ import annotations

import math

PI = repr(math.pi)
SQL: dict[str, str] = {}

SKY = """sky AS (
  SELECT o_orderkey AS id,
         360e0 * ((o_orderkey * o_orderkey * 7919 + o_orderkey * 104729) % 999983) / 999983e0 AS ra,
         degrees(asin(2e0 * ((o_orderkey * o_orderkey * 15485 + o_orderkey * 32452843) % 1000003) / 1000003e0 - 1e0)) AS dec
  FROM orders),
ang AS (SELECT id, radians(90e0 - dec) AS theta, radians(ra) AS phi FROM sky),
vec AS (SELECT id, theta, phi, sin(theta) * cos(phi) AS x, sin(theta) * sin(phi) AS y, cos(theta) AS z FROM ang)"""
NEXT = SKY + """,
nxt AS (SELECT s.id AS id_s, s.theta AS theta_s, s.phi AS phi_s, t.theta AS theta_t, t.phi AS phi_t,
          (s.x-t.x)*(s.x-t.x) + (s.y-t.y)*(s.y-t.y) + (s.z-t.z)*(s.z-t.z) AS r2
        FROM vec s JOIN vec t ON s.id + 1 = t.id)"""


def r8(expr: str) -> str:
    return f"round({expr}, 8) + 0e0"


def rad(arcmin: float) -> float:
    return math.radians(arcmin / 60.0)


def log_edge(lo, hi, n, i):
    return math.exp(math.log(lo) + i * (math.log(hi) - math.log(lo)) / n)


# ---- scans ----
SQL["src1_catalogue_scan"] = "SELECT o_orderkey, o_totalprice FROM orders"
SQL["src2_scan_without_columns"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_LOG = """SELECT CAST(l_linenumber AS BIGINT) AS imin, CAST(l_linenumber + 4 AS BIGINT) AS imax, l_orderkey AS "Ndata",
  l_partkey AS "Ndup", l_extendedprice AS nedges, {mid} l_partkey * 6 AS "NpixJ", (l_suppkey % 5) * 8 + 8 AS nodes,
  q AS part1, q AS part2, q AS part3, {tr} q + 1 AS ts, q + 2 AS td, CAST(0 AS BIGINT) AS tj, q * 2 + 1 AS tb,
  l_tax + l_quantity AS t FROM (SELECT *, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem) AS li"""
LOG_X = _LOG.format(mid='l_suppkey AS "Nj",', tr="")
LOG_R = _LOG.format(mid='l_suppkey AS "nbaseD", l_suppkey * 6 AS "NpixD", q AS "nbaseJ",', tr="q + 3 AS tr,")
SQL["src4_run_log_exact"] = LOG_X
SQL["src4_run_log_reduced"] = LOG_R

# ---- projections ----
SQL["prj1_angles"] = f"WITH {SKY} SELECT id, {r8('theta')} AS theta, {r8('phi')} AS phi FROM ang"
SQL["prj2_unit_vector"] = f"WITH {SKY} SELECT id, {r8('x')} AS x, {r8('y')} AS y, {r8('z')} AS z FROM vec"
SQL["prj3_vector_to_angles"] = f"""WITH {SKY} SELECT id, {r8('acos(z)')} AS theta,
  {r8(f'CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * {PI} ELSE atan2(y, x) END')} AS phi FROM vec"""
SQL["prj4_vector_spherical"] = f"""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x,
  CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
  s AS (SELECT *, sqrt(x*x + y*y + z*z) AS r, atan2(y, x) AS p FROM e)
  SELECT vec_id, {r8('r')} AS r, {r8('acos(z / r)')} AS theta,
  {r8(f'CASE WHEN p < 0 THEN p + 2 * {PI} ELSE p END')} AS phi FROM s"""
SQL["prj5_row_id"] = "SELECT o_orderkey AS id FROM orders"
SQL["prj6_7_8_distances"] = f"""WITH {NEXT} SELECT id_s, {r8('r2')} AS r2, {r8('sqrt(r2)')} AS r,
  round(degrees(2 * asin(least(sqrt(r2) / 2, 1e0))) * 60, 5) AS arcmin FROM nxt"""
SQL["prj9_tangent_residuals"] = f"""WITH {NEXT}, w AS (SELECT *, phi_s - phi_t AS dp FROM nxt)
  SELECT id_s, {r8(f'sin((theta_s + theta_t) / 2) * (dp - 2 * {PI} * floor((dp + {PI}) / (2 * {PI}))) / 0.1e0')} AS dx,
  {r8('(theta_s - theta_t) / 0.1e0')} AS dy FROM w"""


def binned(index: str, rmin: float, rmax: float) -> str:
    return f"""WITH {NEXT} SELECT id_s, CAST({index} AS INTEGER) AS ibin FROM nxt
  WHERE r2 >= {rmin * rmin!r} AND r2 < {rmax * rmax!r}"""


_lo, _hi = rad(log_edge(60.0, 6000.0, 20, 3)), rad(log_edge(60.0, 6000.0, 20, 19))
SQL["prj10_13_log_bin"] = binned(
    f"3 + trunc((ln(r2) / 2 - {math.log(_lo)!r}) / {math.log(100.0) / 20!r})", _lo, _hi)
SQL["prj11_linear_bin"] = binned(f"trunc((sqrt(r2) - {rad(60.0)!r}) / {rad(500.0)!r})", rad(60.0), rad(6060.0))
SQL["prj12_14_pair_columns"] = """SELECT s.o_orderkey AS id_s, t.o_orderkey AS id_t, s.o_custkey * t.o_custkey AS prod
  FROM orders s JOIN orders t ON s.o_orderkey + 1 = t.o_orderkey"""

# ---- filters ----
SQL["flt5_redshift_slice"] = """SELECT o_orderkey FROM orders
  WHERE o_totalprice / 100000e0 + o_custkey / 1000000e0 BETWEEN 1e0 AND 2e0"""
SQL["flt6_in_bounds"] = "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 90"
SQL["flt7_valid_pixel"] = """SELECT o_orderkey AS ipix FROM orders
  WHERE o_orderkey % 10 < 6 AND (o_orderkey // 10) // 20 < 20 AND o_orderkey >= 0"""

# ---- tilings ----
FACES = SKY + """,
fac AS (SELECT id, theta, phi, x, y, z, CASE
    WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x > 0 THEN 0 ELSE 2 END
    WHEN abs(y) >= abs(z) THEN CASE WHEN y > 0 THEN 1 ELSE 3 END
    ELSE CASE WHEN z > 0 THEN 4 ELSE 5 END END AS face FROM vec),
loc AS (SELECT id, face, greatest(abs(x), abs(y), abs(z)) AS n,
    CASE face WHEN 0 THEN y WHEN 1 THEN -x WHEN 2 THEN -y WHEN 3 THEN x ELSE y END AS u,
    CASE WHEN face < 4 THEN z WHEN face = 4 THEN -x ELSE x END AS v FROM fac)"""


def cubed(n: int) -> str:
    def index(c):
        return f"CAST(least({n - 1}, floor((atan({c} / n) + {PI} / 4) / ({PI} / 2 / {n}))) AS BIGINT)"
    return FACES + f""",
pix AS (SELECT id, face, {index('u')} AS i, {index('v')} AS j FROM loc),
num AS (SELECT id, face, i, j, (i * {n} + j) * 10 + face AS ipix FROM pix)"""


def similar(n: int) -> str:
    h = n // 2

    def half(u, v, s):
        g = f"acos(least(1e0, n / sqrt(n*n + {u}*{u}) / sqrt(2e0)))"
        return f"""{g} AS g{s}, {h} * sqrt(12 / {PI} * greatest(0e0, {g} - {PI} / 4)) AS row{s},
    acos(least(1e0, 1 / (sqrt(2e0) * sin({g})))) AS top{s}, asin({v}) AS b{s}"""

    return FACES + f""",
fold AS (SELECT *, abs(u) AS au, abs(v) AS av FROM loc),
half AS (SELECT *, {half('au', 'av', '1')}, {half('av', 'au', '2')} FROM fold),
lo AS (SELECT *, floor(row1) AS i1, floor(row1 * b1 / top1) AS j1, floor(row2) AS i2, floor(row2 * b2 / top2) AS j2 FROM half),
qij AS (SELECT id, face, CASE WHEN v < 0 THEN 1 ELSE 0 END + CASE WHEN u < 0 THEN 2 ELSE 0 END AS quadrant,
    CAST(greatest(0, least({h - 1}, CASE WHEN j1 > i1 THEN j2 ELSE i1 END)) AS BIGINT) AS i,
    CAST(greatest(0, least({h - 1}, CASE WHEN j1 > i1 THEN i2 ELSE j1 END)) AS BIGINT) AS j FROM lo),
num AS (SELECT id, ((CASE WHEN quadrant >= 2 THEN {h - 1} - i ELSE {h} + i END) * {n}
    + (CASE WHEN quadrant % 2 = 1 THEN {h - 1} - j ELSE {h} + j END)) * 10 + face AS ipix FROM qij)"""


def spread(c: str, k: int) -> str:
    return "(" + " + ".join(f"((({c}) // {1 << b}) % 2) * {1 << 2 * b}" for b in range(k)) + ")"


def gather(c: str, k: int) -> str:
    return "(" + " + ".join(f"((({c}) // {1 << 2 * b}) % 2) * {1 << b}" for b in range(k)) + ")"


def healpix(n: int, tag: str = "") -> str:
    k = n.bit_length() - 1
    return f"""hp1{tag} AS (SELECT id, z, abs(z) AS za, phi / ({PI} / 2) AS tt FROM vec),
hp2{tag} AS (SELECT *, CAST(floor((tt + 0.5e0) * {n} - z * {0.75 * n}e0) AS BIGINT) AS jp,
    CAST(floor((tt + 0.5e0) * {n} + z * {0.75 * n}e0) AS BIGINT) AS jm,
    CAST(least(3, floor(tt)) AS BIGINT) AS qt, {n} * sqrt(3 * (1 - za)) AS tm FROM hp1{tag}),
hp3{tag} AS (SELECT *, CAST(floor(jp / {n}e0) AS BIGINT) AS fp, CAST(floor(jm / {n}e0) AS BIGINT) AS fm,
    CAST(least(floor((tt - qt) * tm), {n - 1}) AS BIGINT) AS cp,
    CAST(least(floor((1 - (tt - qt)) * tm), {n - 1}) AS BIGINT) AS cm FROM hp2{tag}),
hp4{tag} AS (SELECT id, CASE WHEN za <= 2e0 / 3 THEN CASE WHEN fp = fm THEN fp % 4 + 4 WHEN fp < fm THEN fp ELSE fm + 8 END
      WHEN z >= 0 THEN qt ELSE qt + 8 END AS face,
    CASE WHEN za <= 2e0 / 3 THEN jm - {n} * fm WHEN z >= 0 THEN {n - 1} - cm ELSE cp END AS ix,
    CASE WHEN za <= 2e0 / 3 THEN {n - 1} - (jp - {n} * fp) WHEN z >= 0 THEN {n - 1} - cp ELSE cm END AS iy FROM hp3{tag}),
num{tag} AS (SELECT id, face * {n * n} + {spread('ix', k)} + 2 * {spread('iy', k)} AS ipix FROM hp4{tag})"""


SQL["til1_cubed_sphere_pixel"] = f"WITH {cubed(120)} SELECT id, ipix FROM num"
SQL["til2_similar_radius_pixel"] = f"WITH {similar(128)} SELECT id, ipix FROM num"
SQL["til3_healpix_pixel"] = f"WITH {SKY}, {healpix(64)} SELECT id, ipix FROM num"
SQL["til4_face"] = f"WITH {FACES} SELECT id, face FROM fac"
SQL["til5_decode_encode"] = f"""WITH {cubed(120)} SELECT id, ipix, CAST(face AS INTEGER) AS face, CAST(i AS INTEGER) AS i,
  CAST(j AS INTEGER) AS j, ipix AS again FROM num"""
SQL["til6_local_index"] = f"WITH {similar(40)} SELECT id, face, quadrant, i, j FROM qij"
SQL["til7_quadrant_bins"] = f"""WITH {cubed(40)} SELECT id, i, j,
  CASE WHEN i < 20 THEN 2 ELSE 0 END + CASE WHEN j < 20 THEN 1 ELSE 0 END AS q,
  CASE WHEN i < 20 THEN 19 - i ELSE i - 20 END AS a, CASE WHEN j < 20 THEN 19 - j ELSE j - 20 END AS b,
  i AS i2, j AS j2 FROM num"""
SQL["til8_quadrant_nodes"] = f"""WITH {cubed(40)} SELECT id, i, j,
  CASE WHEN i <= 20 THEN 2 ELSE 0 END + CASE WHEN j <= 20 THEN 1 ELSE 0 END AS q, abs(i - 20) AS a, abs(j - 20) AS b,
  i AS i2, j AS j2 FROM num"""

# corners: nodes of the grid in the frame of a face, turned to the sphere
AROUND = "(SELECT 0 AS corner, 0 AS di, 0 AS dj UNION ALL SELECT 1, 1, 0 UNION ALL SELECT 2, 1, 1 UNION ALL SELECT 3, 0, 1) AS around"
TURN = """CASE face WHEN 0 THEN n WHEN 1 THEN -u WHEN 2 THEN -n WHEN 3 THEN u WHEN 4 THEN -v ELSE v END AS x,
    CASE face WHEN 0 THEN u WHEN 1 THEN n WHEN 2 THEN -u WHEN 3 THEN -n ELSE u END AS y,
    CASE WHEN face < 4 THEN v WHEN face = 4 THEN n ELSE -n END AS z"""


def grid(n: int) -> str:
    return f"""occ AS (SELECT DISTINCT ipix FROM num),
dec AS (SELECT ipix, ipix % 10 AS face, (ipix // 10) // {n} AS i0, (ipix // 10) % {n} AS j0 FROM occ),
nod AS (SELECT ipix, face, corner, i0 + di AS i, j0 + dj AS j FROM dec, {AROUND})"""


def corners_cubed(n: int) -> str:
    return f"""{cubed(n)}, {grid(n)},
tn AS (SELECT *, tan(i * ({PI} / 2 / {n}) - {PI} / 4) AS a, tan(j * ({PI} / 2 / {n}) - {PI} / 4) AS b FROM nod),
nuv AS (SELECT ipix, face, corner, 1 / sqrt(1 + a*a + b*b) AS n, a / sqrt(1 + a*a + b*b) AS u, b / sqrt(1 + a*a + b*b) AS v FROM tn),
cor AS (SELECT ipix, corner, {TURN} FROM nuv)"""


def corners_similar(n: int) -> str:
    h = n // 2
    return f"""{similar(n)}, {grid(n)},
pq AS (SELECT *, abs(i - {h}) AS p, abs(j - {h}) AS q FROM nod),
gg AS (SELECT *, {PI} / 12 * (greatest(p, q) / {h}e0) * (greatest(p, q) / {h}e0) + {PI} / 4 AS g FROM pq),
ab AS (SELECT *, acos(least(1e0, sqrt(2e0) * cos(g))) AS a,
    CASE WHEN greatest(p, q) = 0 THEN 0e0 ELSE least(p, q) * acos(least(1e0, 1 / (sqrt(2e0) * sin(g)))) / greatest(p, q) END AS b FROM gg),
fn AS (SELECT *, cos(b) * sin(a) AS far, sin(b) AS near FROM ab),
nuv AS (SELECT ipix, face, corner, cos(b) * cos(a) AS n,
    (CASE WHEN i < {h} THEN -1 ELSE 1 END) * (CASE WHEN p >= q THEN far ELSE near END) AS u,
    (CASE WHEN j < {h} THEN -1 ELSE 1 END) * (CASE WHEN p >= q THEN near ELSE far END) AS v FROM fn),
cor AS (SELECT ipix, corner, {TURN} FROM nuv)"""


def corners_quad(n: int) -> str:
    from skypairs.functions.quad_cube import COEFFICIENTS

    def bend(a, b):
        terms, at = [], 0
        for degree in range(7):
            for k in range(degree + 1):
                terms.append(f"({COEFFICIENTS[at]!r}e0) * power({a}, {2 * (degree - k)}) * power({b}, {2 * k})")
                at += 1
        return f"{a} * (1 + (1 - {a} * {a}) * ({' + '.join(terms)}))"

    return f"""{cubed(n)}, {grid(n)},
xy AS (SELECT *, i * (2e0 / {n}) - 1 AS s, j * (2e0 / {n}) - 1 AS t FROM nod),
be AS (SELECT *, {bend('s', 't')} AS a, {bend('t', 's')} AS b FROM xy),
nuv AS (SELECT ipix, face, corner, 1 / sqrt(1 + a*a + b*b) AS n, a / sqrt(1 + a*a + b*b) AS u, b / sqrt(1 + a*a + b*b) AS v FROM be),
cor AS (SELECT ipix, corner, {TURN} FROM nuv)"""


def hp_place(n: int, source: str) -> str:
    """z and phi of the places (ix + px, iy + py) of pixels."""
    k = n.bit_length() - 1
    return f"""hd AS (SELECT *, ipix // {n * n} AS hf, ipix % {n * n} AS rest FROM {source}),
hx AS (SELECT *, ({gather('rest', k)} + px) / {n}e0 AS fx, ({gather('rest // 2', k)} + py) / {n}e0 AS fy FROM hd),
hj AS (SELECT *, 2 + hf // 4 - fx - fy AS hj,
    CASE WHEN hf // 4 = 1 THEN 2 * (hf % 4) ELSE 2 * (hf % 4) + 1 END AS ha FROM hx),
hn AS (SELECT *, CASE WHEN hj < 1 THEN hj WHEN hj > 3 THEN 4 - hj ELSE 1 END AS nr,
    CASE WHEN hj < 1 THEN 1 - hj * hj / 3 WHEN hj > 3 THEN (4 - hj) * (4 - hj) / 3 - 1 ELSE (2 - hj) * 2 / 3 END AS hz FROM hj),
ht AS (SELECT *, ha * nr + fx - fy AS turn FROM hn),
hpl AS (SELECT *, CASE WHEN nr > 0 THEN (turn - 8 * floor(turn / 8)) / nr * ({PI} / 4) ELSE 0 END AS hphi FROM ht)"""


def corners_healpix(n: int, base: str | None = None) -> str:
    base = base or f"{SKY}, {healpix(n)}, occ AS (SELECT DISTINCT ipix FROM num)"
    return f"""{base},
cp AS (SELECT ipix, corner, px, py FROM occ, (SELECT 0 AS corner, 1 AS px, 1 AS py UNION ALL SELECT 1, 0, 1
    UNION ALL SELECT 2, 0, 0 UNION ALL SELECT 3, 1, 0) AS around),
{hp_place(n, 'cp')},
cor AS (SELECT ipix, corner, sqrt(greatest(0e0, (1 - hz) * (1 + hz))) * cos(hphi) AS x,
    sqrt(greatest(0e0, (1 - hz) * (1 + hz))) * sin(hphi) AS y, hz AS z FROM hpl)"""


_COR = f"SELECT ipix, corner, {r8('x')} AS x, {r8('y')} AS y, {r8('z')} AS z FROM cor"
SQL["til12_cubed_sphere_corners"] = f"WITH {corners_cubed(40)} {_COR}"
SQL["til12_similar_radius_corners"] = f"WITH {corners_similar(40)} {_COR}"
SQL["til12_quad_cube_corners"] = f"WITH {corners_quad(40)} {_COR}"
SQL["til12_healpix_corners"] = f"WITH {corners_healpix(32)} {_COR}"

CENTRES = """cs AS (SELECT ipix, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cor GROUP BY ipix),
cen AS (SELECT ipix, mx / sqrt(mx*mx + my*my + mz*mz) AS cx, my / sqrt(mx*mx + my*my + mz*mz) AS cy,
    mz / sqrt(mx*mx + my*my + mz*mz) AS cz FROM cs)"""
# an azimuth that is zero but for rounding may come out just below a full turn
_AZ = f"CASE WHEN atan2(cy, cx) < 0 THEN atan2(cy, cx) + 2 * {PI} ELSE atan2(cy, cx) END"
_CEN = f"SELECT ipix, {r8('acos(cz)')} AS theta_c, {r8(_AZ)} AS phi_c FROM cen"
SQL["til9_cubed_sphere_centre"] = f"WITH {corners_cubed(120)}, {CENTRES} {_CEN}"
SQL["til10_similar_radius_centre"] = f"WITH {corners_similar(128)}, {CENTRES} {_CEN}"
_HPC = "oc AS (SELECT ipix, 0.5e0 AS px, 0.5e0 AS py FROM (SELECT DISTINCT ipix FROM num) AS d)"
SQL["til11_healpix_centre"] = f"""WITH {SKY}, {healpix(64)}, {_HPC}, {hp_place(64, 'oc')}
  SELECT ipix, {r8('acos(hz)')} AS theta_c, {r8('hphi')} AS phi_c FROM hpl"""

# two pixels are neighbours when they share a corner
ALL_CUBE = """allp AS (SELECT (i * {n} + j) * 10 + f AS ipix, f AS face, i AS i0, j AS j0
    FROM range(6) AS rf(f), range({n}) AS ri(i), range({n}) AS rj(j)),
ncor AS (SELECT ipix, face, {n} AS n, 2 * (i0 + di) - {n} AS u, 2 * (j0 + dj) - {n} AS v FROM allp, """ + AROUND + """),
pcor AS (SELECT ipix, """ + TURN + """ FROM ncor),
nb AS (SELECT DISTINCT a.ipix, b.ipix AS neighbour FROM pcor a JOIN pcor b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.ipix <> b.ipix)"""


def cube_neighbours(n: int) -> str:
    return f"{cubed(n)}, occ AS (SELECT DISTINCT ipix FROM num), " + ALL_CUBE.replace("{n}", str(n))


SQL["til13_cube_neighbours"] = f"WITH {cube_neighbours(40)} SELECT ipix, neighbour FROM nb WHERE ipix IN (SELECT ipix FROM occ)"
SQL["til14_healpix_neighbours"] = f"""WITH {corners_healpix(16, base='occ AS (SELECT range AS ipix FROM range(3072))')},
  {SKY}, {healpix(16)},
  rc AS (SELECT ipix, round(x, 7) + 0e0 AS x, round(y, 7) + 0e0 AS y, round(z, 7) + 0e0 AS z FROM cor)
  SELECT DISTINCT a.ipix, b.ipix AS neighbour FROM rc a JOIN rc b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.ipix <> b.ipix
  WHERE a.ipix IN (SELECT ipix FROM num)"""
SQL["til15_flt4_padded_neighbours"] = f"""WITH {cube_neighbours(10)} SELECT ipix, 8 AS n_padded, count(*) AS n FROM nb
  WHERE ipix IN (SELECT ipix FROM occ) GROUP BY ipix"""
SQL["til16_pixel_table_occupancy"] = f"""WITH {cube_neighbours(40)}, c AS (SELECT ipix, count(*) AS n FROM num GROUP BY ipix)
  SELECT allp.ipix, coalesce(n, 0) AS n FROM allp LEFT JOIN c ON allp.ipix = c.ipix"""
SQL["til18_multi_resolution"] = f"""WITH {SKY}, {', '.join(healpix(n, str(n)) for n in (32, 64, 128))}
  SELECT a.id, a.ipix AS id32, b.ipix AS id64, c.ipix AS id128 FROM num32 a JOIN num64 b ON a.id = b.id JOIN num128 c ON a.id = c.id"""
SQL["til19_make_cells"] = f"""WITH {SKY}, {healpix(32)}, oc AS (SELECT ipix, count(*) AS cnt, 0.5e0 AS px, 0.5e0 AS py FROM num GROUP BY ipix),
  {hp_place(32, 'oc')} SELECT ipix AS id32, cnt AS "N", {r8('sqrt((1 - hz) * (1 + hz)) * cos(hphi)')} AS x32,
  {r8('sqrt((1 - hz) * (1 + hz)) * sin(hphi)')} AS y32, {r8('hz')} AS z32 FROM hpl"""


def speed_cube(corners: str, n: int) -> str:
    return f"""WITH {corners}, {CENTRES}, {ALL_CUBE.replace('{n}', str(n))}, nn AS (SELECT ipix, count(*) AS k FROM nb GROUP BY ipix)
  SELECT min(cen.ipix) AS min_ipix, max(cen.ipix) AS max_ipix, {r8('min(acos(cz))')} AS min_theta_c,
  {r8(f'min({_AZ})')} AS min_phi_c, CAST(min(k) AS INTEGER) AS min_neighbours FROM cen JOIN nn ON cen.ipix = nn.ipix"""


SQL["til20_speed_cubed_sphere"] = speed_cube(corners_cubed(40), 40)
SQL["til20_speed_similar_radius"] = speed_cube(corners_similar(40), 40)

SQL["til20_speed_healpix"] = f"""WITH {corners_healpix(32, base='occ AS (SELECT range AS ipix FROM range(12288))')},
  rc AS (SELECT ipix, round(x, 7) + 0e0 AS x, round(y, 7) + 0e0 AS y, round(z, 7) + 0e0 AS z FROM cor),
  nb AS (SELECT DISTINCT a.ipix, b.ipix AS other FROM rc a JOIN rc b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.ipix <> b.ipix),
  nn AS (SELECT ipix, count(*) AS k FROM nb GROUP BY ipix), {SKY}, {healpix(32)},
  oc AS (SELECT DISTINCT ipix, 0.5e0 AS px, 0.5e0 AS py FROM num), {hp_place(32, 'oc').replace('hd AS', 'gd AS').replace('hx AS', 'gx AS').replace('hj AS (', 'gj AS (').replace('hn AS', 'gn AS').replace('ht AS', 'gt AS').replace('hpl AS', 'gpl AS').replace('FROM hd', 'FROM gd').replace('FROM hx', 'FROM gx').replace('FROM hj', 'FROM gj').replace('FROM hn', 'FROM gn').replace('FROM ht', 'FROM gt')}
  SELECT min(gpl.ipix) AS min_ipix, max(gpl.ipix) AS max_ipix, {r8('min(acos(hz))')} AS min_theta_c, {r8('min(hphi)')} AS min_phi_c,
    CAST(min(k) AS INTEGER) AS min_neighbours FROM gpl JOIN nn ON gpl.ipix = nn.ipix"""

# ---- pairs ----


def brute(cols: str, lo: float, hi: float, source: str = "vec") -> str:
    """Pairs with lo <= r < hi, every pair once."""
    d = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"
    reach = hi * (1 + 1e-9)
    return f"""SELECT {cols}, {d} AS r2 FROM {source} AS a JOIN {source} AS b
    ON b.z >= a.z - {reach!r} AND b.z <= a.z + {reach!r} AND a.id < b.id
    WHERE {d} >= {lo * lo!r} AND {d} < {hi * hi!r}"""


def log_table(lo=2.5, hi=250.0, n=20, imin=0, imax=19) -> str:
    e = f"exp({math.log(lo)!r} + {{}} * {(math.log(hi) - math.log(lo)) / n!r})"
    return f"""bins AS (SELECT CAST(range AS INTEGER) AS ibin, {e.format('range')} AS lo, {e.format('(range + 1)')} AS hi
    FROM range({imin}, {imax + 1}))"""


def lin_table(lo, hi, n) -> str:
    w = (hi - lo) / n
    return f"""bins AS (SELECT CAST(range AS INTEGER) AS ibin, {lo!r}e0 + range * {w!r}e0 AS lo,
    {lo!r}e0 + (range + 1) * {w!r}e0 AS hi FROM range({n}))"""


COUNTS = f"""SELECT bins.ibin, {r8('lo')} AS lo, {r8('hi')} AS hi, {r8('hi - lo')} AS width, CAST(k AS BIGINT) AS "Nbin"
  FROM bins JOIN cnt ON bins.ibin = cnt.ibin"""


def log_counts(imin=0, imax=19, head=SKY, source="vec", weight="", metric="chord") -> str:
    lo, hi = rad(log_edge(2.5, 250.0, 20, imin)), rad(log_edge(2.5, 250.0, 20, imax + 1))
    step = (math.log(250.0) - math.log(2.5)) / 20
    cols = "a.w * b.w AS w" if weight else "1 AS w"
    arc = "2 * asin(least(1e0, sqrt(r2) / 2))"
    s2 = "r2" if metric == "chord" else f"power({arc}, 2)"
    return f"""WITH {head}, {log_table(imin=imin, imax=imax)}, prs AS ({brute(cols, lo * (1 - 1e-3), hi, source)}),
cnt AS (SELECT CAST({imin} + trunc((ln({s2}) / 2 - {math.log(lo)!r}) / {step!r}) AS INTEGER) AS ibin, sum(w) AS k FROM prs
  WHERE {s2} >= {lo * lo!r} AND {s2} < {hi * hi!r} GROUP BY ALL)"""


def lin_counts(lo, hi, n, head=SKY, source="vec", weight="") -> str:
    cols = "a.w * b.w AS w" if weight else "1 AS w"
    return f"""WITH {head}, {lin_table(lo, hi, n)}, prs AS ({brute(cols, rad(lo), rad(hi), source)}),
cnt AS (SELECT CAST(trunc((sqrt(r2) - {rad(lo)!r}) / {rad((hi - lo) / n)!r}) AS INTEGER) AS ibin, sum(w) AS k FROM prs GROUP BY ALL)"""


EDGES = f"WITH {SKY}, e AS ({brute('a.id AS id, b.id AS id2', 0.0, rad(100.0))})"
for name in ("jon1_neighbour_join_cubed_sphere", "jon2_neighbour_join_healpix", "jon3_flt2_flt3_pair_list"):
    SQL[name] = f"{EDGES} SELECT id, id2 FROM e"
SQL["jon4_attach_bins"] = f"""WITH {log_table(1000.0, 1000000.0, 30, 0, 29)},
  cnt AS (SELECT CAST(floor((ln(o_totalprice) - ln(1000e0)) / ((ln(1000000e0) - ln(1000e0)) / 30)) AS INTEGER) AS ibin,
    count(*) AS k FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 1000000 GROUP BY ALL) {COUNTS}"""

CELLS_CS = f"""{corners_cubed(400)}, {CENTRES},
wgt AS (SELECT ipix, count(*) AS w FROM num GROUP BY ipix),
cells AS (SELECT cen.ipix AS id, w, cx AS x, cy AS y, cz AS z FROM cen JOIN wgt ON cen.ipix = wgt.ipix)"""
_exact = log_counts()
SQL["agg3_reduced_counts_log"] = f"{log_counts(0, 19, CELLS_CS, 'cells', 'w')} {COUNTS}"
SQL["jon5_agg23_exact_vs_reduced"] = f"""WITH ex AS ({_exact} {COUNTS}), re AS ({SQL['agg3_reduced_counts_log']})
  SELECT ex.ibin, ex."Nbin" AS "N", re."Nbin" AS "N1", {r8('1 - re."Nbin" / CAST(ex."Nbin" AS DOUBLE)')} AS rel
  FROM ex JOIN re ON ex.ibin = re.ibin"""
CELLS_HP = f"""{SKY}, {healpix(256)}, oc AS (SELECT ipix, count(*) AS w, 0.5e0 AS px, 0.5e0 AS py FROM num GROUP BY ipix),
{hp_place(256, 'oc')}, cells AS (SELECT ipix AS id, w, sqrt((1 - hz) * (1 + hz)) * cos(hphi) AS x,
  sqrt((1 - hz) * (1 + hz)) * sin(hphi) AS y, hz AS z FROM hpl)"""
SQL["agg4_reduced_counts_linear"] = f"{lin_counts(2.5, 252.5, 5, CELLS_HP, 'cells', 'w')} {COUNTS}"

PRICES = """pr AS (SELECT o_custkey, min(o_totalprice) / 1000e0 AS lo, max(o_totalprice) / 1000e0 + 1e0 AS hi FROM orders GROUP BY o_custkey),
prw AS (SELECT o_custkey, lo, hi, hi - lo AS width FROM pr)"""
_RADII = {"cs": (0.77, 1.26), "sr": (0.82, 1.1)}


def coarse(t: str) -> str:
    f = f"CAST(floor(degrees(sqrt({PI} / 6) / (hi / 2)) * 60 * {_RADII[t][0]}e0) AS BIGINT)"
    return f"({f} - {f} % 2)"


def fine(t: str) -> str:
    f = f"CAST(ceil(degrees(sqrt({PI} / 3) / (width / 2)) * 60 * {_RADII[t][1]}e0) AS BIGINT)"
    return f"({f} + {f} % 2)"


SQL["jon6_two_bin_setups"] = f"""WITH {PRICES} SELECT o_custkey, {fine('cs')} AS d_cs, {coarse('cs')} AS j_cs,
  {fine('sr')} AS d_sr, {coarse('sr')} AS j_sr FROM prw"""
SQL["bin4_5_resolutions_cube"] = f"""WITH {PRICES}, b AS (SELECT o_custkey, {fine('sr')} AS d, {coarse('cs')} AS j FROM prw)
  SELECT o_custkey, d AS "nbaseD", 6 * d * d AS "NpixD", j AS "nbaseJ", 6 * j * j AS "NpixJ" FROM b"""
SQL["bin6_resolutions_healpix"] = f"""WITH {PRICES}, b AS (SELECT o_custkey,
  CAST(power(2, ceil(log2(degrees(sqrt({PI} / 6) / (width / 2)) * 60 * 1.48e0))) AS BIGINT) AS d,
  CAST(power(2, floor(log2(degrees(sqrt({PI} / 12) / (hi / 2)) * 60 * 0.65e0))) AS BIGINT) AS j FROM prw)
  SELECT o_custkey, d AS "nbaseD", 12 * d * d AS "NpixD", j AS "nbaseJ", 12 * j * j AS "NpixJ" FROM b"""
SQL["bin8_radius_nside"] = f"""WITH {PRICES} SELECT o_custkey,
  CAST(power(2, greatest(0, floor(-log2(radians(hi / 60))))) AS BIGINT) AS nside FROM prw"""

# ---- aggregations ----
for name in ("agg1_pair_counts_log", "agg1_pair_counts_bulk", "agg1_pair_counts_on_cubed_sphere", "plc1_partitioned_counts"):
    SQL[name] = f"{log_counts()} {COUNTS}"
SQL["agg1_pair_counts_log_arc"] = f"{log_counts(metric='arc')} {COUNTS}"
SQL["agg2_pair_counts_linear"] = f"{lin_counts(2.5, 252.5, 5)} {COUNTS}"
SQL["agg5_weighted_cells"] = f"""WITH {corners_similar(40)}, {CENTRES}, w AS (SELECT ipix, count(*) AS w FROM num GROUP BY ipix)
  SELECT cen.ipix, w, {r8('cx')} AS x, {r8('cy')} AS y, {r8('cz')} AS z FROM cen JOIN w ON cen.ipix = w.ipix"""
SQL["agg6_total_pairs"] = f"{log_counts()} SELECT CAST(sum(k) AS BIGINT) AS n_pairs FROM cnt WHERE ibin < 20"
DEG = f"{EDGES}, deg AS (SELECT id, count(*) AS degree FROM (SELECT id FROM e UNION ALL SELECT id2 FROM e) AS u GROUP BY id)"
SQL["agg7_degrees"] = SQL["agg7_degrees_bulk"] = f"{DEG} SELECT id, degree FROM deg"
SQL["agg7_degrees_directed"] = f"{EDGES} SELECT id, count(*) AS degree FROM e GROUP BY id"
SQL["agg8_degree_summary"] = f"""{DEG} SELECT count(*) AS n, {r8('avg(degree)')} AS mean, {r8('stddev_samp(degree)')} AS stddev,
  min(degree) AS min, max(degree) AS max, CAST(sum(degree) AS BIGINT) AS total FROM deg"""
SQL["agg9_min_max"] = """SELECT min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice,
  min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem"""
SQL["agg10_missing_count"] = "SELECT count(*) AS n_missing FROM events WHERE NOT coalesce(value > 10, FALSE) OR event_id IS NULL"
SQL["agg11_missing_fraction"] = f"""SELECT {r8('sum(CASE WHEN coalesce(value > 10, FALSE) THEN 0 ELSE 1 END) / CAST(count(*) AS DOUBLE)')}
  AS missing_fraction FROM events"""


def hist(source: str, column: str, n: int, lo: str, hi: str) -> str:
    return f"""h0 AS (SELECT CAST({column} AS DOUBLE) AS v, {lo} AS lo, {hi} AS hi FROM {source}),
h1 AS (SELECT CAST(trunc((v - lo) / ((hi - lo) / {n})) AS BIGINT) AS bin, any_value(lo) AS lo, any_value((hi - lo) / {n}) AS s, count(*) AS c
    FROM h0 WHERE v BETWEEN lo AND hi GROUP BY ALL)
SELECT {r8('lo + s / 2 + bin * s')} AS loc, c AS count FROM h1 WHERE bin <> {n}"""


SQL["agg12_histogram"] = "WITH " + hist("lineitem", "l_extendedprice", 50, "(SELECT min(l_extendedprice) FROM lineitem)",
                                        "(SELECT max(l_extendedprice) FROM lineitem)")
SQL["agg12_histogram_bounded"] = "WITH " + hist("customer", "c_acctbal", 40, "0e0", "8000e0")
SQL["agg13_histogram_2d"] = """WITH m AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_quantity) AS c,
    max(l_quantity) AS d FROM lineitem),
  w AS (SELECT a - (b - a) * 1e-6 AS a, b + (b - a) * 1e-6 AS b, c - (d - c) * 1e-6 AS c, d + (d - c) * 1e-6 AS d FROM m)
  SELECT CAST(trunc((l_extendedprice - a) / ((b - a) / 20)) AS INTEGER) AS bin1,
    CAST(trunc((l_quantity - c) / ((d - c) / 10)) AS INTEGER) AS bin2, count(*) AS count FROM lineitem, w GROUP BY ALL"""
SQL["agg13_histogram_2d_dense"] = f"""WITH c AS (SELECT CAST(trunc(l_extendedprice / 5000e0) AS INTEGER) AS bin1,
    CAST(trunc((l_quantity - 1) / 6.25e0) AS INTEGER) AS bin2, count(*) AS k FROM lineitem
    WHERE l_extendedprice BETWEEN 0 AND 60000 AND l_quantity BETWEEN 1 AND 51 GROUP BY ALL),
  g AS (SELECT CAST(a AS INTEGER) AS bin1, CAST(b AS INTEGER) AS bin2 FROM range(12) AS ra(a), range(8) AS rb(b))
  SELECT g.bin1, g.bin2, {r8('2500e0 + g.bin1 * 5000e0')} AS loc1, {r8('1e0 + 3.125e0 + g.bin2 * 6.25e0')} AS loc2,
    coalesce(k, 0) AS count FROM g LEFT JOIN c ON g.bin1 = c.bin1 AND g.bin2 = c.bin2"""
SQL["agg14_column_statistics"] = """SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean,
  round(stddev_samp(c_acctbal), 6) AS stddev, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer"""
SQL["agg15_histogram_moments"] = """WITH h AS (SELECT l_quantity AS x, count(*) AS y FROM lineitem GROUP BY ALL),
  m AS (SELECT avg(l_quantity) AS mu FROM lineitem),
  c AS (SELECT count(*) AS n, avg(power(l_quantity - mu, 2)) AS m2, avg(power(l_quantity - mu, 3)) AS m3,
    avg(power(l_quantity - mu, 4)) AS m4, any_value(mu) AS mu FROM lineitem, m)
  SELECT n, (SELECT x FROM h ORDER BY y DESC, x LIMIT 1) AS mode, round(mu, 6) AS mean, round(sqrt(m2), 6) AS stdev,
    round(m3 / power(m2, 1.5), 6) + 0e0 AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM c"""
SQL["agg15_histogram_fwhm"] = f"""WITH h AS (SELECT floor(l_extendedprice / 5000e0) AS x, CAST(count(*) AS DOUBLE) AS y FROM lineitem GROUP BY ALL),
  p AS (SELECT x AS mode, y / 2 AS half FROM h ORDER BY y DESC, x LIMIT 1),
  s AS (SELECT 'r' AS side, x, y FROM h, p WHERE x >= mode UNION ALL SELECT 'l', x, y FROM h, p WHERE x <= mode),
  o AS (SELECT side, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, count(*) OVER (PARTITION BY side) AS k
    FROM s WINDOW w AS (PARTITION BY side ORDER BY y, x)),
  c AS (SELECT side, x0 + (half - y0) / (y1 - y0) * (x1 - x0) AS place FROM o, p WHERE k > 5 AND y0 <= half AND y1 > half),
  b AS (SELECT side, max(k) AS k FROM o GROUP BY side)
  SELECT {r8("(SELECT CASE WHEN k > 5 THEN (SELECT place FROM c WHERE side = 'r') ELSE mode END FROM b WHERE side = 'r') - (SELECT CASE WHEN k > 5 THEN (SELECT place FROM c WHERE side = 'l') ELSE mode END FROM b WHERE side = 'l')")} AS fwhm FROM p"""


def residuals(n: int) -> str:
    ideal = math.sqrt(4 * math.pi / (6 * n * n) / 2)
    return f"""{corners_cubed(n)}, {CENTRES},
rs AS (SELECT cen.ipix, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) AS r, acos(cz) AS tc, theta,
    phi - ({_AZ}) AS dp FROM num JOIN vec ON num.id = vec.id JOIN cen ON cen.ipix = num.ipix),
res AS (SELECT ipix, r, sin((theta + tc) / 2) * (dp - 2 * {PI} * floor((dp + {PI}) / (2 * {PI}))) / {ideal!r} AS dx,
    (theta - tc) / {ideal!r} AS dy FROM rs)"""


_A20 = 4 * math.pi / (6 * 400)
_I20 = math.sqrt(_A20 / 2)
SQL["agg16_sampled_radii"] = f"""WITH {residuals(20)}, m AS (SELECT ipix, max(r) AS b, {_A20 / 2!r} / max(r) AS a FROM res GROUP BY ipix),
  k AS (SELECT *, a * b / sqrt(a*a + b*b) AS c FROM m)
  SELECT ipix, {r8('b')} AS "Rmax", {r8('a')} AS "Rmin", {r8('c')} AS "Rin", {r8(f'c / {_I20 / math.sqrt(2)!r}')} AS "Rin_rel",
    {r8(f'b / {_I20!r}')} AS "Rout_rel" FROM k"""
SQL["agg17_residual_map"] = f"""WITH {residuals(20)}, c AS (SELECT CAST(trunc((dx + 1.5e0) / 0.015e0) AS INTEGER) AS bin1,
    CAST(trunc((dy + 1.5e0) / 0.015e0) AS INTEGER) AS bin2, count(*) AS count FROM res
    WHERE dx BETWEEN -1.5 AND 1.5 AND dy BETWEEN -1.5 AND 1.5 GROUP BY ALL)
  SELECT bin1, bin2, count, {r8('log10(1e0 + count)')} AS log_count FROM c WHERE bin1 <> 200 AND bin2 <> 200"""
SQL["agg18_occupancy"] = f"WITH {cubed(20)}, occ AS (SELECT count(*) AS k FROM num GROUP BY ipix), " + hist("occ", "k", 10, "0e0", "(SELECT max(k) + 1e0 FROM occ)")


def geometry(corners: str, npix: int, centres: str = CENTRES) -> str:
    mean = 4 * math.pi / npix
    ideal = math.sqrt(mean / 2)

    def d2(p, q):
        return " + ".join(f"({p}.{c} - {q}.{c}) * ({p}.{c} - {q}.{c})" for c in "xyz")

    def height(p, q, s):
        return f"2 * sqrt(greatest(0e0, (({p}+{q}+{s})/2) * ((-{p}+{q}+{s})/2) * (({p}-{q}+{s})/2) * (({p}+{q}-{s})/2))) / {s}"

    arm = "sqrt(" + " + ".join("({p}.%s - c%s) * ({p}.%s - c%s)" % (c, c, c, c) for c in "xyz") + ")"
    return f"""{corners}, {centres},
q4 AS (SELECT cen.ipix, {d2('a', 'c')} AS p2, {d2('b', 'd')} AS q2, {d2('a', 'b')} AS s1, {d2('b', 'c')} AS s2,
    {d2('c', 'd')} AS s3, {d2('d', 'a')} AS s4, {arm.format(p='a')} AS o1, {arm.format(p='b')} AS o2, {arm.format(p='c')} AS o3, {arm.format(p='d')} AS o4
  FROM cen JOIN cor a ON a.ipix = cen.ipix AND a.corner = 0 JOIN cor b ON b.ipix = cen.ipix AND b.corner = 1
    JOIN cor c ON c.ipix = cen.ipix AND c.corner = 2 JOIN cor d ON d.ipix = cen.ipix AND d.corner = 3),
geo AS (SELECT ipix, round(sqrt(4 * p2 * q2 - power(s2 + s4 - s1 - s3, 2)) / 4 / {mean!r}, 6) AS area,
    round((sqrt(p2) - sqrt(q2)) / (sqrt(p2) + sqrt(q2)), 6) + 0e0 AS ellipticity, round(greatest(o1, o2, o3, o4) / {ideal!r}, 6) AS outer_r,
    round(least({height('o1', 'o2', 'sqrt(s1)')}, {height('o2', 'o3', 'sqrt(s2)')}, {height('o3', 'o4', 'sqrt(s3)')},
      {height('o4', 'o1', 'sqrt(s4)')}) / {ideal / math.sqrt(2)!r}, 6) AS inner_r FROM q4)"""


_GEO = 'SELECT ipix, area, ellipticity, outer_r AS "outer", inner_r AS "inner" FROM geo'
SQL["agg19_geometry_cubed_sphere"] = f"WITH {geometry(corners_cubed(40), 9600)} {_GEO}"
SQL["agg19_geometry_similar_radius"] = f"WITH {geometry(corners_similar(40), 9600)} {_GEO}"
SQL["agg19_geometry_quad_cube"] = f"WITH {geometry(corners_quad(40), 9600)} {_GEO}"
_HP_CEN = """px AS (SELECT DISTINCT ipix, fx0, fy0, hf FROM (SELECT ipix, hf, fx - px / 32e0 + 0.5e0 / 32 AS fx0, fy - py / 32e0 + 0.5e0 / 32 AS fy0
    FROM hpl WHERE corner = 2) AS s),
pj AS (SELECT ipix, fx0 - fy0 AS df, 2 + hf // 4 - fx0 - fy0 AS j, CASE WHEN hf // 4 = 1 THEN 2 * (hf % 4) ELSE 2 * (hf % 4) + 1 END AS ha FROM px),
pn AS (SELECT ipix, df, ha, CASE WHEN j < 1 THEN j WHEN j > 3 THEN 4 - j ELSE 1 END AS nr,
    CASE WHEN j < 1 THEN 1 - j * j / 3 WHEN j > 3 THEN (4 - j) * (4 - j) / 3 - 1 ELSE (2 - j) * 2 / 3 END AS cz FROM pj),
cen AS (SELECT ipix, sqrt((1 - cz) * (1 + cz)) * cos((ha * nr + df) / nr * pi() / 4) AS cx,
    sqrt((1 - cz) * (1 + cz)) * sin((ha * nr + df) / nr * pi() / 4) AS cy, cz FROM pn)"""
SQL["agg19_geometry_healpix"] = f"WITH {geometry(corners_healpix(32), 12288, _HP_CEN)} {_GEO}"
SQL["agg20_geometry_summary"] = f"""WITH {geometry(corners_similar(40), 9600)}
  SELECT min(inner_r) AS min_inner, max(outer_r) AS max_outer FROM geo"""
SQL["agg20_radius_histogram"] = f"WITH {geometry(corners_cubed(40), 9600)}, " + hist("geo", "outer_r", 80, "0.6e0", "1.5e0")
SQL["agg21_time_by_nodes"] = f"""WITH l AS ({LOG_R}) SELECT nodes, count(*) AS runs, round(avg(t), 6) AS t, round(stddev_pop(t), 6) AS sig,
  round(avg(tr), 6) AS tr, round(avg(ts), 6) AS ts, round(avg(td), 6) AS td, round(avg(tj), 6) AS tj, round(avg(tb), 6) AS tb,
  min("Ndata") AS "Ndata", min(imin) AS imin, min(imax) AS imax, min("NpixJ") AS "NpixJ", min("NpixD") AS "NpixD" FROM l GROUP BY nodes"""
SQL["agg22_phase_shares"] = f"""WITH l AS ({LOG_X}), m AS (SELECT nodes, avg(ts) AS a, avg(td) AS b, avg(tj) + avg(tb) AS c FROM l GROUP BY nodes)
  SELECT nodes, round(a * 100 / (a + b + c), 6) AS source, round(b * 100 / (a + b + c), 6) AS duplicate,
  round(c * 100 / (a + b + c), 6) AS "join" FROM m"""
SQL["agg24_stage_counts"] = f"""{log_counts(head=cube_neighbours(14))}, nn AS (SELECT ipix, count(*) AS k FROM nb GROUP BY ipix)
  SELECT (SELECT count(*) FROM num) AS "Ndata", (SELECT CAST(sum(k + 1) AS BIGINT) FROM num JOIN nn ON num.ipix = nn.ipix) AS "Ndup",
  (SELECT CAST(sum(k) AS BIGINT) FROM cnt WHERE ibin < 20) AS nedges"""

# ---- bins, order, sets ----
SQL["bin1_log_bins_of_data"] = f"""WITH {PRICES} SELECT o_custkey, CAST(i AS INTEGER) AS ibin,
  {r8('exp(ln(lo) + i * ((ln(hi) - ln(lo)) / 20))')} AS lo, {r8('exp(ln(lo) + (i + 1) * ((ln(hi) - ln(lo)) / 20))')} AS hi
  FROM prw, range(20) AS r(i)"""
SQL["bin2_ary4_linear_bins_of_data"] = f"""WITH {PRICES} SELECT o_custkey, CAST(i AS INTEGER) AS ibin,
  {r8('lo + i * width / 5')} AS lo, {r8('lo + (i + 1) * width / 5')} AS hi FROM prw, range(5) AS r(i)"""
SQL["bin3_bin_range"] = f"{log_counts(5, 12)} {COUNTS}"
SQL["srt1_lim1_first_bins"] = f"{log_counts()} {COUNTS} ORDER BY bins.ibin LIMIT 5"
SQL["set1_union_of_counts"] = f"({log_counts(10, 14)} {COUNTS}) UNION ALL ({log_counts(15, 19)} {COUNTS})"
SQL["ary1_2_3_set2_neighbour_arrays"] = f"""WITH {cube_neighbours(40)} SELECT ipix, CAST(count(*) AS INTEGER) AS n, CAST(NULL AS BIGINT) AS none,
  CAST(count(*) AS INTEGER) AS n_distinct FROM nb WHERE ipix IN (SELECT ipix FROM occ) GROUP BY ipix"""

# ---- wide and tiny reaches, crowds, gaps, defaults ----
CUSTOMER_SKY = SKY.replace("o_orderkey", "c_custkey").replace("FROM orders", "FROM customer")
_AFTER = SKY[SKY.index("ang AS"):]
TWINS = f"""one AS (SELECT * FROM ({CUSTOMER_SKY[CUSTOMER_SKY.index('SELECT'):CUSTOMER_SKY.index('),')]}) AS s),
sky AS (SELECT id * 2 + t AS id, ra, dec + (CASE WHEN dec > 0 THEN -1e0 ELSE 1e0 END) * t / 60000e0 AS dec FROM one, range(2) AS r(t)),
{_AFTER}"""
CROWD = f"""sky AS (SELECT o_orderkey AS id, 40e0 + o_custkey % 3 * 30 + ((o_orderkey * 7919) % 199) / 398e0 AS ra,
  10e0 + ((o_orderkey * 104729) % 211) / 422e0 AS dec FROM orders), {_AFTER}"""
_UNEVEN = "CASE WHEN o_orderkey % 4 < 2 THEN 0.1e0 WHEN o_orderkey % 4 = 2 THEN 1e0 ELSE 20e0 END"
UNEVEN = f"""sky AS (SELECT o_orderkey AS id, 40e0 + {_UNEVEN} * ((o_orderkey * 7919) % 9973) / 9973e0 AS ra,
  10e0 + {_UNEVEN} * ((o_orderkey * 104729) % 10007) / 10007e0 AS dec FROM orders), {_AFTER}"""
GAPS = f"{SKY}, ok AS (SELECT * FROM vec WHERE id % 7 > 1 AND id % 5 > 1)"
SQL["agg1_pair_counts_crowded"] = f"{lin_counts(0.0, 30.0, 6, CROWD)} {COUNTS}"
SQL["agg1_pair_counts_uneven"] = SQL["plc2_stored_counts"] = f"{lin_counts(1.0, 61.0, 6, UNEVEN)} {COUNTS}"
SQL["prj5_row_numbers"] = """SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS id
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem) AS t"""
_DRAW = "CAST('0x' || substr(md5('42:{}:' || o_orderkey), 1, 13) AS BIGINT) / 4503599627370496e0"
SQL["src3_random_directions"] = f"""SELECT o_orderkey, {r8(f'acos({_DRAW.format(0)} * 2 - 1)')} AS theta,
  {r8(f'{_DRAW.format(1)} * 2 * {PI}')} AS phi FROM orders"""
SQL["agg24_observed_stages"] = SQL["agg24_stage_counts"]
SQL["til18_til19_rolled_cells"] = " UNION ALL ".join(f"""(WITH {SKY}, {healpix(n)}, oc AS (SELECT ipix, count(*) AS cnt, 0.5e0 AS px, 0.5e0 AS py FROM num GROUP BY ipix),
  {hp_place(n, 'oc')} SELECT {n} AS nside, ipix, cnt AS w, {r8('sqrt((1 - hz) * (1 + hz)) * cos(hphi)')} AS x,
  {r8('sqrt((1 - hz) * (1 + hz)) * sin(hphi)')} AS y, {r8('hz')} AS z FROM hpl)""" for n in (16, 32, 64, 128))
SQL["agg1_pair_counts_twins"] = f"{lin_counts(0.0, 0.002, 1, TWINS)} {COUNTS}"
SQL["jon3_pair_list_twins"] = f"WITH {TWINS}, e AS ({brute('a.id AS id, b.id AS id2', 0.0, rad(0.002))}) SELECT id, id2 FROM e"
SQL["jon3_pair_list_crowded"] = f"WITH {CROWD}, e AS ({brute('a.id AS id, b.id AS id2', 0.0, rad(0.5))}) SELECT id, id2 FROM e"
SQL["agg1_pair_counts_with_gaps"] = f"{lin_counts(2.5, 252.5, 5, GAPS, 'ok')} {COUNTS}"
SQL["agg5_weighted_cells_with_gaps"] = SQL["agg5_weighted_cells"].replace(
    "FROM num GROUP BY ipix)\n", "FROM num WHERE id % 7 > 1 AND id % 5 > 1 GROUP BY ipix)\n")
for _name, _head, _source, _reach in (("agg7_degrees_with_gaps", GAPS, "ok", 100.0), ("agg7_degrees_crowded", CROWD, "vec", 10.0), ("agg7_degrees_uneven", UNEVEN, "vec", 5.0)):
    SQL[_name] = f"""WITH {_head}, e AS ({brute('a.id AS id, b.id AS id2', 0.0, rad(_reach), _source)})
  SELECT id, count(*) AS degree FROM (SELECT id FROM e UNION ALL SELECT id2 FROM e) AS u GROUP BY id"""
for _name in ("cubedsphere", "similar_radius", "healpix"):
    SQL[f"agg1_wide_counts_{_name}"] = f"{lin_counts(0.0, 6000.0, 6, CUSTOMER_SKY)} {COUNTS}"
SQL["agg1_pair_counts_on_similar_radius"] = SQL["agg1_pair_counts_log"]
# the coarsest even resolution whose pixels have an outer radius (1.1 ideal ones) below half the first bin's width
_width = log_edge(2.5, 250.0, 20, 16) - log_edge(2.5, 250.0, 20, 15)
_n = math.ceil(math.degrees(math.sqrt(math.pi / 3) / (_width / 2)) * 60 * 1.1)
_n += _n % 2
CELLS_SR = f"""{corners_similar(_n)}, {CENTRES}, wgt AS (SELECT ipix, count(*) AS w FROM num GROUP BY ipix),
cells AS (SELECT cen.ipix AS id, w, cx AS x, cy AS y, cz AS z FROM cen JOIN wgt ON cen.ipix = wgt.ipix)"""
SQL["agg3_reduced_counts_default_cells"] = f"{log_counts(15, 19, CELLS_SR, 'cells', 'w')} {COUNTS}"
_E = "exp(ln(2.5e0) + {} * (ln(top) - ln(2.5e0)) / 20)"
SQL["bin4_bin_setup"] = f"""WITH t AS (SELECT max(o_totalprice) / 1000e0 AS top FROM orders),
  b AS (SELECT CAST(i AS INTEGER) AS ibin, {_E.format('i')} AS lo, {_E.format('(i + 1)')} AS hi FROM t, range(20) AS r(i)),
  w AS (SELECT *, hi - lo AS width FROM b), n AS (SELECT *, {fine('sr')} AS d, {coarse('cs')} AS j FROM w)
  SELECT ibin, {r8('lo')} AS lo, {r8('hi')} AS hi, {r8('width')} AS width, d AS "nbaseD", 6 * d * d AS "NpixD",
    j AS "nbaseJ", 6 * j * j AS "NpixJ" FROM n"""
SQL["udf1_column_forms"] = f"""WITH {corners_cubed(40)}, {CENTRES}, {ALL_CUBE.replace('{n}', '40')},
  nn AS (SELECT ipix, count(*) AS n, min(neighbour) AS least FROM nb GROUP BY ipix)
  SELECT num.id, num.ipix, {r8('cx')} AS x, {r8('cy')} AS y, {r8('cz')} AS z, CAST(n AS INTEGER) AS n, least
  FROM num JOIN cen ON num.ipix = cen.ipix JOIN nn ON num.ipix = nn.ipix"""

# ---- whole tilings and whole bin ranges ----
def all_pixels(name: str, n: int, points: str = "", hp: bool = False) -> str:
    """The SQL of a query over occupied pixels, over all pixels of the tiling; points: WITH of the pixel of each point, to
    add the number of points of each pixel."""
    every = (f"SELECT range AS ipix FROM range({12 * n * n})" if hp else
             f"SELECT (i * {n} + j) * 10 + f AS ipix FROM range(6) AS rf(f), range({n}) AS ri(i), range({n}) AS rj(j)")
    old = SQL[name]
    new = old.replace("(SELECT DISTINCT ipix FROM num)", f"({every})").replace("IN (SELECT ipix FROM num)", f"IN ({every})")
    assert new != old, name
    if not points:
        return new
    return f"""SELECT s.*, CAST(coalesce(c.k, 0) AS BIGINT) AS n FROM ({new}) AS s
  LEFT JOIN (WITH {points} SELECT ipix, count(*) AS k FROM num GROUP BY ipix) AS c ON s.ipix = c.ipix"""


for _name, _at, _k, _h in (
        ("til9_cubed_sphere_centre", cubed, 120, False), ("til10_similar_radius_centre", similar, 128, False),
        ("til11_healpix_centre", healpix, 64, True), ("til13_cube_neighbours", cubed, 40, False),
        ("til14_healpix_neighbours", healpix, 16, True),
        *((q, at, k, h) for t, at, k, h in (("cubed_sphere", cubed, 40, False), ("similar_radius", similar, 40, False),
                                            ("quad_cube", cubed, 40, False), ("healpix", healpix, 32, True))
          for q in (f"til12_{t}_corners", f"agg19_geometry_{t}"))):
    SQL[f"{_name}_all_pixels"] = all_pixels(_name, _k, f"{SKY}, {healpix(_k)}" if _h else _at(_k), _h)
for _name in ("agg20_geometry_summary", "agg20_radius_histogram"):
    SQL[f"{_name}_all_pixels"] = all_pixels(_name, 40)
SQL["set1_union_of_counts_all_bins"] = f"({log_counts(0, 9)} {COUNTS}) UNION ALL ({log_counts(10, 19)} {COUNTS})"
# cells as fine as half the width of the first of all bins
_width0 = log_edge(2.5, 250.0, 20, 1) - log_edge(2.5, 250.0, 20, 0)
_n0 = math.ceil(math.degrees(math.sqrt(math.pi / 3) / (_width0 / 2)) * 60 * 1.1)
_n0 += _n0 % 2
CELLS_SR0 = f"""{corners_similar(_n0)}, {CENTRES}, wgt AS (SELECT ipix, count(*) AS w FROM num GROUP BY ipix),
cells AS (SELECT cen.ipix AS id, w, cx AS x, cy AS y, cz AS z FROM cen JOIN wgt ON cen.ipix = wgt.ipix)"""
SQL["agg3_reduced_counts_default_cells_all_bins"] = f"{log_counts(0, 19, CELLS_SR0, 'cells', 'w')} {COUNTS}"
SQL["plc1_bucketed_counts"] = SQL["agg1_pair_counts_log"]
for _name in ("cubedsphere", "similar_radius", "healpix"):
    SQL[f"jon1_jon2_rings_{_name}"] = SQL["agg1_pair_counts_log"]
for _name, _head, _reach in (("agg7_degrees_directed_uneven", UNEVEN, 5.0), ("agg7_degrees_directed_crowded", CROWD, 10.0)):
    SQL[_name] = f"""WITH {_head}, e AS ({brute('a.id AS id, b.id AS id2', 0.0, rad(_reach))})
  SELECT least(id, id2) AS id, count(*) AS degree FROM e GROUP BY 1"""

# ---- shapes by symmetry: the same shapes, each from its own corners ----
for _name in ("cubed_sphere", "similar_radius", "quad_cube", "healpix"):
    SQL[f"agg19_geometry_{_name}_by_symmetry"] = SQL[f"agg19_geometry_{_name}_all_pixels"]
SQL["agg20_geometry_summary_by_symmetry"] = SQL["agg20_geometry_summary"]
SQL["agg20_radius_of_points_by_symmetry"] = f"""WITH {geometry(corners_cubed(40), 9600)},
  of_points AS (SELECT outer_r FROM geo JOIN num ON geo.ipix = num.ipix), """ + hist("of_points", "outer_r", 80, "0.6e0", "1.5e0")
