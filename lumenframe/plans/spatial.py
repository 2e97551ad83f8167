"""Queries over point clouds, surfaces, sensitivities and decompositions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import transforms
from ..operators import decomposition, geodesics, geometry, imaging
from ..operators import landmarks as landmark_lines
from .common import query, r
from .tables import ADOT, CHANNELS, COEF, FACES, GEO, adot, channels, faces, geo, spectrum, ts

ROT = transforms.m_trans([1.0, -2.0, 0.5]) @ transforms.m_rot([0.0, 0.0, np.pi / 2]) @ transforms.m_scale1(2.0)
D2 = "(p.x-v.x)*(p.x-v.x)+(p.y-v.y)*(p.y-v.y)+(p.z-v.z)*(p.z-v.z)"


TURNED = "(-2*p.y+1-v.x)*(-2*p.y+1-v.x)+(2*p.x-2-v.y)*(2*p.x-2-v.y)+(2*p.z+0.5-v.z)*(2*p.z+0.5-v.z)"
SNAP_SQL = f"WITH {GEO}, d AS (SELECT p.label, v.vertex, {TURNED} AS d2 FROM geo p, geo v WHERE p.vertex % 50 = 0) SELECT label, arg_min(vertex, (d2, vertex)) AS vertex, {r('sqrt(min(d2))', 'distance')} FROM d GROUP BY 1"


def turned(spark, d):
    """The points whose number divides by 50, elsewhere."""
    return geometry.affine(geo(spark, d).where("vertex % 50 = 0"), ROT).drop("vertex")


@query(SNAP_SQL)
def surface_snap(spark, d):
    """The query points against all vertices."""
    return geometry.snap(turned(spark, d), geo(spark, d).drop("label"))


@query(SNAP_SQL)
def surface_snap_cells(spark, d):
    return geometry.snap(turned(spark, d), geo(spark, d).drop("label"), 0.05)


@query(f"WITH {GEO} SELECT vertex, label, {r('-2 * y + 1', 'x')}, {r('2 * x - 2', 'y')}, {r('2 * z + 0.5', 'z')} FROM geo")
def affine_transform(spark, d):
    return geometry.affine(geo(spark, d), ROT)


@query(f"WITH {GEO}, {CHANNELS} SELECT label FROM geo INTERSECT SELECT detector FROM channels")
def common_labels(spark, d):
    """Points that are a channel's detector."""
    return geometry.common_labels(geo(spark, d), channels(spark, d).select(F.col("detector").alias("label")))


@query(f"WITH {GEO} SELECT vertex, label, {r('x')}, {r('y')}, {r('z')} FROM geo WHERE label NOT IN ('P1', 'P2') UNION ALL SELECT vertex, 'Q' || label, {r('x')}, {r('y')}, {r('z')} FROM geo")
def points_add_remove(spark, d):
    g = geo(spark, d)
    return geometry.add_points(geometry.remove_points(g, ["P1", "P2"]), g.withColumn("label", F.concat(F.lit("Q"), "label")))


@query(f"WITH {GEO} SELECT vertex, label, {r('atan2(y, x)', 'az')}, {r('atan2(z, sqrt(x*x+y*y))', 'el')}, {r('sqrt(x*x+y*y+z*z)', 'r')}, {r('x')}, {r('y')}, {r('z')} FROM geo")
def cart2sph(spark, d):
    return geometry.cart2sph(geo(spark, d))


def landmarks(spark, d):
    names = {"P0": "Nz", "P1": "LPA", "P2": "RPA"}
    return geometry.rename_points(geo(spark, d), names)


FRAME = """lm AS (SELECT n.x AS nx, n.y AS ny, n.z AS nz, (l.x+q.x)/2 AS ox, (l.y+q.y)/2 AS oy, (l.z+q.z)/2 AS oz, q.x AS qx, q.y AS qy, q.z AS qz
  FROM geo n, geo l, geo q WHERE n.label = 'P0' AND l.label = 'P1' AND q.label = 'P2'),
ax AS (SELECT *, qx-ox AS ex, qy-oy AS ey, qz-oz AS ez, nx-ox AS fx, ny-oy AS fy, nz-oz AS fz FROM lm),
cr AS (SELECT *, ey*fz-ez*fy AS gx, ez*fx-ex*fz AS gy, ex*fy-ey*fx AS gz, sqrt(ex*ex+ey*ey+ez*ez) AS s FROM ax),
pj AS (SELECT label, ((x-ox)*ex+(y-oy)*ey+(z-oz)*ez)/s AS a, ((x-ox)*fx+(y-oy)*fy+(z-oz)*fz)/s AS b, ((x-ox)*gx+(y-oy)*gy+(z-oz)*gz)/sqrt(gx*gx+gy*gy+gz*gz) AS c FROM geo, cr)"""


@query(f"WITH {GEO}, {FRAME} SELECT CASE label WHEN 'P0' THEN 'Nz' WHEN 'P1' THEN 'LPA' WHEN 'P2' THEN 'RPA' ELSE label END AS label, {r('cos(atan2(c, sqrt(a*a+b*b))) * cos(atan2(b, a))', 'u')}, {r('cos(atan2(c, sqrt(a*a+b*b))) * sin(atan2(b, a))', 'v')} FROM pj")
def scalp_projection(spark, d):
    return geometry.scalp_projection(landmarks(spark, d))


@query(f"WITH {GEO}, c AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM geo) SELECT {r('stddev_pop(sqrt((g.x-c.x)*(g.x-c.x)+(g.y-c.y)*(g.y-c.y)+(g.z-c.z)*(g.z-c.z)))', 'spread')} FROM geo g, c")
def points_spread(spark, d):
    return geometry.spread_of(geo(spark, d))


@query(f"WITH {GEO}, f AS (SELECT x, y, z, label FROM geo ORDER BY label LIMIT 1), d AS (SELECT g.label, f.label AS l0, row_number() OVER (ORDER BY (g.x-f.x)*(g.x-f.x)+(g.y-f.y)*(g.y-f.y)+(g.z-f.z)*(g.z-f.z), g.label) - 1 AS rn, count(*) OVER () AS n FROM geo g, f) SELECT CASE WHEN label = l0 THEN 'first' WHEN rn = n - 1 THEN 'farthest' ELSE 'median' END AS role, label FROM d WHERE label = l0 OR rn = n - 1 OR rn = n // 2")
def spread_points(spark, d):
    return geometry.spread_points(geo(spark, d))


@query()
def register_rigid(spark, d):
    g = geo(spark, d)
    m = geometry.register(g, geometry.affine(g, ROT), "trans_rot_isoscale")
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(4) for j in range(4)], "i int, j int, value double")


CORN = "cn AS (SELECT face, a, b, c, p.x AS ax, p.y AS ay, p.z AS az, q.x-p.x AS ux, q.y-p.y AS uy, q.z-p.z AS uz, s.x-p.x AS vx, s.y-p.y AS vy, s.z-p.z AS vz FROM faces JOIN geo p ON p.vertex=a JOIN geo q ON q.vertex=b JOIN geo s ON s.vertex=c), nm AS (SELECT *, uy*vz-uz*vy AS nx, uz*vx-ux*vz AS ny, ux*vy-uy*vx AS nz FROM cn), fn AS (SELECT face, a, b, c, nx/l AS nx, ny/l AS ny, nz/l AS nz, l/2 AS area FROM (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM nm))"
MESH = f"{GEO}, {FACES}, {CORN}"


@query(f"WITH {MESH} SELECT face, a, b, c, {r('nx')}, {r('ny')}, {r('nz')}, {r('area')} FROM fn")
def face_normals(spark, d):
    return geometry.face_normals(faces(spark, d), geo(spark, d))


VN = "vn AS (SELECT vertex, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz FROM (SELECT unnest([a, b, c]) AS vertex, nx, ny, nz FROM fn) GROUP BY 1)"


@query(f"WITH {MESH}, {VN} SELECT vertex, {r('nx / sqrt(nx*nx+ny*ny+nz*nz)', 'nx')}, {r('ny / sqrt(nx*nx+ny*ny+nz*nz)', 'ny')}, {r('nz / sqrt(nx*nx+ny*ny+nz*nz)', 'nz')} FROM vn")
def vertex_normals(spark, d):
    return geometry.vertex_normals(faces(spark, d), geo(spark, d))


ED = "ed AS (SELECT least(p, q) AS i, greatest(p, q) AS j, count(*) AS n FROM (SELECT a AS p, b AS q FROM faces UNION ALL SELECT b, c FROM faces UNION ALL SELECT c, a FROM faces) GROUP BY ALL)"


@query(f"""WITH {MESH}, di AS (SELECT vertex, z - 0.25 * x AS d, x, y, z FROM geo), si AS (SELECT face, p.d >= 0 AS pu, q.d >= 0 AS qu, s.d >= 0 AS su, p, q, s FROM faces JOIN di p ON p.vertex = a JOIN di q ON q.vertex = b JOIN di s ON s.vertex = c),
al AS (SELECT face, CASE WHEN pu <> qu AND pu <> su THEN [p, q, s] WHEN qu <> pu AND qu <> su THEN [q, s, p] WHEN su <> pu AND su <> qu THEN [s, p, q] END AS t FROM si)
SELECT face, least(t[1].vertex, t[2].vertex) AS i1, greatest(t[1].vertex, t[2].vertex) AS j1, {r('t[1].x + t[1].d / (t[1].d - t[2].d) * (t[2].x - t[1].x)', 'x1')}, {r('t[1].z + t[1].d / (t[1].d - t[2].d) * (t[2].z - t[1].z)', 'z1')},
  least(t[1].vertex, t[3].vertex) AS i2, greatest(t[1].vertex, t[3].vertex) AS j2, {r('t[1].x + t[1].d / (t[1].d - t[3].d) * (t[3].x - t[1].x)', 'x2')}, {r('t[1].z + t[1].d / (t[1].d - t[3].d) * (t[3].z - t[1].z)', 'z2')} FROM al WHERE t IS NOT NULL""")
def surface_cut(spark, d):
    """Where the plane z = x / 4 crosses the surface."""
    line = (np.zeros(3), np.array([4.0, 0.0, 1.0]), np.array([0.0, 1.0, 0.0]))
    cut = landmark_lines.plane_cut(geometry.corners(faces(spark, d), geo(spark, d)), {"slope": line})
    return cut.select("face", "i1", "j1", "x1", "z1", "i2", "j2", "x2", "z2")


@query(f"WITH {MESH}, {ED} SELECT i, j, n FROM ed")
def surface_edges(spark, d):
    return geometry.edges(faces(spark, d))


@query(f"WITH {MESH}, {ED} SELECT {r('avg(sqrt(' + D2 + '))', 'length')} FROM ed JOIN geo p ON p.vertex = i JOIN geo v ON v.vertex = j")
def average_edge_length(spark, d):
    return geometry.average_edge_length(faces(spark, d), geo(spark, d))


COT = "(({q}.x-{p}.x)*({s}.x-{p}.x)+({q}.y-{p}.y)*({s}.y-{p}.y)+({q}.z-{p}.z)*({s}.z-{p}.z)) / (2*area) / 2"
LAP = f"""ct AS (SELECT b AS i, c AS j, {COT.format(p='p', q='q', s='s')} AS w FROM fn JOIN geo p ON p.vertex=a JOIN geo q ON q.vertex=b JOIN geo s ON s.vertex=c
 UNION ALL SELECT c, a, {COT.format(p='q', q='s', s='p')} FROM fn JOIN geo p ON p.vertex=a JOIN geo q ON q.vertex=b JOIN geo s ON s.vertex=c
 UNION ALL SELECT a, b, {COT.format(p='s', q='p', s='q')} FROM fn JOIN geo p ON p.vertex=a JOIN geo q ON q.vertex=b JOIN geo s ON s.vertex=c),
lp AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w FROM ct UNION ALL SELECT j, i, w FROM ct) GROUP BY ALL)"""


@query(f"WITH {MESH}, {LAP} SELECT i, j, {r('w', 'weight')} FROM lp UNION ALL SELECT i, i, {r('-sum(w)', 'weight')} FROM lp GROUP BY i")
def surface_laplacian(spark, d):
    return geometry.laplacian(faces(spark, d), geo(spark, d))


@query(f"WITH {MESH} SELECT vertex, {r('sum(area / 3)', 'area')} FROM (SELECT unnest([a, b, c]) AS vertex, area FROM fn) GROUP BY 1")
def vertex_areas(spark, d):
    return geometry.vertex_areas(faces(spark, d), geo(spark, d))


@query()
def surface_gradient(spark, d):
    g = geo(spark, d)
    return geometry.surface_gradient(faces(spark, d), g, g.select("vertex", F.col("x").alias("value")))


def source(spark, d):
    return geo(spark, d).where("vertex = 0").select("vertex")


@query()
def geodesic_distance(spark, d):
    """Along the strip of triangles, which is numbered along, from its first vertex."""
    return geodesics.geodesic_distance(faces(spark, d), geo(spark, d), source(spark, d), by=F.col("a"))


STRIP = """st AS (SELECT v.vertex AS v, sqrt((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y)+(v.z-p.z)*(v.z-p.z)) AS e1, sqrt((v.x-q.x)*(v.x-q.x)+(v.y-q.y)*(v.y-q.y)+(v.z-q.z)*(v.z-q.z)) AS e2 FROM geo v LEFT JOIN geo p ON p.vertex = v.vertex - 1 LEFT JOIN geo q ON q.vertex = v.vertex - 2),
sp AS (SELECT 0::BIGINT AS v, 0.0::DOUBLE AS d, 'inf'::DOUBLE AS before UNION ALL SELECT st.v, least(sp.d + e1, sp.before + coalesce(e2, 'inf')), sp.d FROM sp JOIN st ON st.v = sp.v + 1)"""


@query(f"WITH RECURSIVE {GEO}, {STRIP} SELECT v AS vertex, {r('d', 'distance')} FROM sp")
def edge_distance(spark, d):
    """The shortest way that follows edges, by the same rounds."""
    return geodesics.geodesic_distance(faces(spark, d), geo(spark, d), source(spark, d), by=F.col("a"), through_faces=False)


@query(f"WITH RECURSIVE {GEO}, {STRIP}, o AS (SELECT x, y, z FROM geo WHERE vertex = 0) SELECT v AS vertex, {r('sqrt((g.x-o.x)*(g.x-o.x)+(g.y-o.y)*(g.y-o.y)+(g.z-o.z)*(g.z-o.z))', 'straight')}, {r('d', 'edges')}, TRUE AS between FROM sp JOIN geo g ON g.vertex = v, o")
def geodesic_bounds(spark, d):
    """The way across faces is no shorter than the straight line and no longer than the way along edges."""
    g, f = geo(spark, d), faces(spark, d)
    over = geodesics.geodesic_distance(f, g, source(spark, d), by=F.col("a"))
    edge = geodesics.geodesic_distance(f, g, source(spark, d), by=F.col("a"), through_faces=False).withColumnRenamed("distance", "edges")
    at = g.where("vertex = 0").select(*[F.col(c).alias(f"_{c}") for c in "xyz"])
    straight = g.crossJoin(F.broadcast(at)).select("vertex", F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in "xyz"), F.lit(0.0))).alias("straight"))
    return straight.join(edge, "vertex").join(over, "vertex").select("vertex", "straight", "edges", F.col("distance").between(F.col("straight") - 1e-9, F.col("edges") + 1e-9).alias("between"))


@query()
def geodesic_path(spark, d):
    """Down from every vertex whose number divides by 50."""
    g, f = geo(spark, d), faces(spark, d)
    distances = geodesics.geodesic_distance(f, g, source(spark, d), by=F.col("a"))
    return geodesics.geodesic_path(f, distances, g.where("vertex % 50 = 0").select("vertex"), longest=1_000_000)


@query(f"WITH {ADOT}, {COEF} SELECT channel, wavelength, chromo, vertex, {r('value * coef', 'value')} FROM adot JOIN coef USING (wavelength)")
def stacked_sensitivity(spark, d):
    return imaging.stacked_sensitivity(adot(spark, d).drop("parcel"), coef(spark))


def coef(spark):
    from ..operators.optics import extinction_coefficients

    return extinction_coefficients(spectrum(spark), [760.0, 850.0])


@query(f"WITH {ADOT}, {COEF}, ch AS (SELECT wavelength, sum(coef * CASE chromo WHEN 'HbO' THEN 10e-6 ELSE -3e-6 END) AS d FROM coef GROUP BY 1), s AS (SELECT channel, wavelength, parcel, sum(value) AS s FROM adot WHERE channel <> 'A3' GROUP BY ALL), h AS (SELECT channel, parcel, bool_or(abs(s * d) > 0.001) AS hit FROM s JOIN ch USING (wavelength) GROUP BY ALL) SELECT parcel, count(*) FILTER (WHERE hit) AS n_channels, count(*) FILTER (WHERE hit) >= 10 AS mask FROM h GROUP BY parcel")
def parcel_sensitivity(spark, d):
    return imaging.parcel_sensitivity(adot(spark, d), coef(spark), ["A3"], 0.001, 10)


@query(f"WITH {ADOT} SELECT channel, wavelength, parcel, {r('sum(value)', 'value')} FROM adot GROUP BY ALL")
def parcel_sum(spark, d):
    a = adot(spark, d)
    return imaging.by_parcel(a.drop("parcel"), a.select("vertex", "parcel").distinct())


OD = "o AS (SELECT channel, wavelength, sample, (length(channel) + wavelength / 1000 + sample)::DOUBLE AS value FROM (SELECT DISTINCT channel, wavelength FROM adot), (SELECT unnest(range(0, 5)) AS sample))"


@query(f"WITH {ADOT}, {OD} SELECT 'HbO' AS chromo, vertex, sample, {r('sum(o.value * adot.value)', 'value')} FROM o JOIN adot USING (channel, wavelength) GROUP BY vertex, sample")
def apply_inverse(spark, d):
    a = adot(spark, d)
    o = a.select("channel", "wavelength").distinct().join(spark.range(5).select(F.col("id").alias("sample")))
    o = o.withColumn("value", F.length("channel") + F.col("wavelength") / 1000 + F.col("sample"))
    return imaging.apply_inverse(o, a.drop("parcel").withColumn("chromo", F.lit("HbO")))


@query()
def pseudo_inverse(spark, d):
    return imaging.pseudo_inverse(imaging.stacked_sensitivity(adot(spark, d).drop("parcel"), coef(spark)), 0.01, 0.01)


@query(f"WITH {GEO} SELECT vertex, sample, {r('exp(-(x*x+y*y+z*z) / (2*0.01)) * exp(-0.5 * pow((sample / 10.0 - 0.4) / 0.2, 2)) * 3', 'value')} FROM geo, (SELECT unnest(range(0, 10)) AS sample)")
def mock_activation(spark, d):
    t = spark.range(10).select(F.col("id").alias("sample"), (F.col("id") / 10).alias("time"))
    return imaging.mock_activation(geo(spark, d), (0, 0, 0), t, 0.1, 0.4, 0.2, 3.0)


def features(spark, d):
    return adot(spark, d).select(F.concat_ws("_", "channel", F.col("wavelength").cast("int").cast("string")).alias("channel"), F.col("vertex").alias("sample"), "value")


@query(f"WITH {ADOT}, f AS (SELECT channel || '_' || wavelength::INT AS channel, vertex AS sample, value FROM adot) SELECT x.channel AS a, y.channel AS b, {r('sum(x.value * y.value)', 'g')} FROM f x JOIN f y USING (sample) GROUP BY 1, 2")
def gram_matrix(spark, d):
    f = features(spark, d)
    return decomposition.cross_gram(f, f)


@query()
def pca(spark, d):
    return decomposition.pca(features(spark, d), 4)[0]


@query()
def cca(spark, d):
    f = features(spark, d)
    x, y = f.where(F.col("channel").endswith("760")), f.where(F.col("channel").endswith("850"))
    return decomposition.cca(x, y, 2, l2=(0.1, 0.1))[0]


@query()
def sparse_cca(spark, d):
    f = features(spark, d)
    return decomposition.cca(f.where(F.col("channel").endswith("760")), f.where(F.col("channel").endswith("850")), 1, l1=(0.05, 0.05))[1]


@query()
def pls(spark, d):
    f = features(spark, d)
    return decomposition.cca(f.where(F.col("channel").endswith("760")), f.where(F.col("channel").endswith("850")), 2, pls=True)[0]


@query()
def spoc(spark, d):
    f = features(spark, d)
    z = spark.range(8).select(F.col("id").cast("int").alias("bin"), F.sin(F.col("id")).alias("value"))
    return decomposition.spoc(f, z, 8)[0]


@query()
def remove_components(spark, d):
    return decomposition.remove_components(features(spark, d), 2)
