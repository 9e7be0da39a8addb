"""Column builders for poses, lenses, directions and splines. Vectors are (x, y, z) tuples of columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Camera models as (number, name, number of parameters).
MODELS = (
    (0, "SIMPLE_PINHOLE", 3), (1, "PINHOLE", 4), (2, "SIMPLE_RADIAL", 4), (3, "RADIAL", 5), (4, "OPENCV", 8), (5, "OPENCV_FISHEYE", 8),
    (6, "FULL_OPENCV", 12), (7, "FOV", 5), (8, "SIMPLE_RADIAL_FISHEYE", 4), (9, "RADIAL_FISHEYE", 5), (10, "THIN_PRISM_FISHEYE", 12),
    (11, "SPHERE", 3), (17, "EQUIRECTANGULAR", 2),
)
#: Models with one focal length before the principal point, and with two.
ONE_FOCAL = ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE")
TWO_FOCAL = ("PINHOLE", "OPENCV", "OPENCV_FISHEYE", "FULL_OPENCV", "FOV", "THIN_PRISM_FISHEYE")

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector, least: float = 1e-12) -> Vector:
    """a over its length; a null vector where that is within `least` of 0."""
    n = norm(a)
    return tuple(F.when(n > least, x / n) for x in a)


def rotation(qw: Column, qx: Column, qy: Column, qz: Column) -> list[Vector]:
    """The rows of the rotation matrix of a unit quaternion."""
    return [
        (1 - 2 * qy * qy - 2 * qz * qz, 2 * qx * qy - 2 * qw * qz, 2 * qz * qx + 2 * qw * qy),
        (2 * qx * qy + 2 * qw * qz, 1 - 2 * qx * qx - 2 * qz * qz, 2 * qy * qz - 2 * qw * qx),
        (2 * qz * qx - 2 * qw * qy, 2 * qy * qz + 2 * qw * qx, 1 - 2 * qx * qx - 2 * qy * qy),
    ]


def centre(r: list[Vector], t: Vector) -> Vector:
    """Where the camera stands: minus the transposed rotation times the translation."""
    return tuple(-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2]) for i in range(3))


def axis(r: list[Vector]) -> Vector:
    """Where it looks: the rotation's third row, of length 1."""
    return unit(r[2])


def to_camera(r: list[Vector], t: Vector, p: Vector) -> Vector:
    return tuple(dot(r[i], p) + t[i] for i in range(3))


def inverse(r: list[Vector], t: Vector) -> tuple[list[Vector], Vector]:
    """The rigid inverse of a pose."""
    return [tuple(r[j][i] for j in range(3)) for i in range(3)], centre(r, t)


def angle_degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def lens(focal_mm: Column, sensor_mm: Column, width: Column, height: Column) -> Column:
    """struct(fx, hfov, vfov, mm35): focal length in pixels, both fields of view in degrees, and for a 36 mm wide sensor."""
    fx = focal_mm / sensor_mm * width
    return F.struct(fx.alias("fx"), F.degrees(2 * F.atan(width / (2 * fx))).alias("hfov"), F.degrees(2 * F.atan(height / (2 * fx))).alias("vfov"), (focal_mm * 36.0 / sensor_mm).alias("mm35"))


def turned(v: Vector, about: Vector, degrees: Column) -> Vector:
    """v turned about a unit axis by an angle."""
    a, k = F.radians(degrees), dot(about, v)
    c = cross(about, v)
    return tuple(v[i] * F.cos(a) + c[i] * F.sin(a) + about[i] * k * (1 - F.cos(a)) for i in range(3))


def frustum_rays(forward: Vector, up: Vector, hfov: Column, vfov: Column) -> dict[str, Vector]:
    """The middle rays of a view's four edges."""
    side = unit(cross(forward, up))
    return {"left": turned(forward, up, hfov / 2), "right": turned(forward, up, -hfov / 2), "top": turned(forward, side, vfov / 2), "bottom": turned(forward, side, -vfov / 2)}


def panorama_direction(x: Column, y: Column, width: Column, height: Column) -> Vector:
    """The direction of a panorama's pixel centre; u runs backwards."""
    theta, phi = (1 - (x + 0.5) / width) * (2 * pi), (y + 0.5) / height * pi
    return F.sin(phi) * F.cos(theta), F.sin(phi) * F.sin(theta), F.cos(phi)


def panorama_uv(d: Vector) -> tuple[Column, Column]:
    """The inverse, in 0..1: u wraps, v is clamped."""
    u = 1 - F.pmod(F.atan2(d[1], d[0]) / (2 * pi), F.lit(1.0))
    return u, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d[2]))) / pi


def cloud_direction(x: Column, y: Column, width: Column, height: Column) -> Vector:
    """The direction of a pixel in the cloud's own convention, with another origin and height - 1 rows."""
    lon, lat = (x / width - 0.5) * (2 * pi), (0.5 - y / F.greatest(height - 1, F.lit(1))) * pi
    return F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)


def intrinsics(model: Column, params: Column) -> Column:
    """struct(fx, fy, cx, cy) of a projectable model, null for others."""
    p = lambda i: F.get(params, F.lit(i))
    make = lambda a, b, c, d: F.struct(a.alias("fx"), b.alias("fy"), c.alias("cx"), d.alias("cy"))
    return F.when(model.isin(*ONE_FOCAL), make(p(0), p(0), p(1), p(2))).when(model.isin(*TWO_FOCAL), make(p(0), p(1), p(2), p(3)))


def rescaled(model: Column, params: Column, sx: Column, sy: Column, tolerance: float = 1e-9) -> Column:
    """struct(model, params) for an image scaled by sx and sy. Unequal factors make a SIMPLE_PINHOLE a PINHOLE; for other
    models with one focal length they fail the query, as does a model that is no pinhole."""
    p = lambda i: F.get(params, F.lit(i))
    even = F.abs(sx - sy) <= tolerance
    tail = lambda n: F.slice(params, n + 1, F.greatest(F.size(params) - n, F.lit(0)))
    make = lambda m, a: F.struct(m.alias("model"), a.alias("params"))
    bad = F.raise_error(F.concat(F.lit("can't scale unevenly: "), model)).cast("array<double>")
    return (
        F.when(model.isin(*TWO_FOCAL), make(model, F.concat(F.array(p(0) * sx, p(1) * sy, p(2) * sx, p(3) * sy), tail(4))))
        .when(model.isin(*ONE_FOCAL) & even, make(model, F.concat(F.array(p(0) * sx, p(1) * sx, p(2) * sy), tail(3))))
        .when(model == "SIMPLE_PINHOLE", make(F.lit("PINHOLE"), F.array(p(0) * sx, p(0) * sy, p(1) * sx, p(2) * sy)))
        .otherwise(make(model, bad))
    )


def equirectangular(camera_id: Column, model: Column, params: Column, width: Column, height: Column) -> Column:
    """struct(model, params) of a panorama camera: SPHERE becomes EQUIRECTANGULAR with the panorama's size as parameters; what is
    one already stays as it is; any other model fails the query."""
    wrong = F.raise_error(F.concat(F.lit("camera "), camera_id.cast("string"), F.lit(" is no panorama: "), model)).cast("array<double>")
    size = F.array(width.cast("double"), height.cast("double"))
    made = F.when(model == "SPHERE", size).when(model == "EQUIRECTANGULAR", params).otherwise(wrong)
    return F.struct(F.lit("EQUIRECTANGULAR").alias("model"), made.alias("params"))


def on_sphere_grid(model: Column, params: Column, width: Column, height: Column) -> Column:
    """The parameters of a SPHERE camera on a grid of another size: the focal length stays, the centre is the grid's. Parameters
    of other models, and of fewer than three numbers, stay as they are."""
    centred = F.concat(F.slice(params, 1, 1), F.array(width / 2.0, height / 2.0), F.slice(params, 4, F.greatest(F.size(params) - 3, F.lit(0))))
    return F.when((model == "SPHERE") & (F.size(params) >= 3), centred).otherwise(params)


def spline_point(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """A uniform Catmull-Rom segment from p1 to p2."""
    return 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t)


def spline_tangent(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    return 0.5 * ((p2 - p0) + 2 * (2 * p0 - 5 * p1 + 4 * p2 - p3) * t + 3 * (3 * p1 - p0 - 3 * p2 + p3) * t * t)
