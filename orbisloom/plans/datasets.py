"""Dataset plans: compositions of the operators over camera, image, observation, point and track tables.

Tables: camera(camera_id, model, width, height, params), image(image_id, qw..qz, tx..tz, camera_id, name), disk(name, width,
height), point(point3d_id, x, y, z, ...), track(point3d_id, pos, image_id, idx).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions.frames import batch_size
from ..functions.keys import face_of, frame_of, hires_of
from ..operators import aggregates as agg
from ..operators import ordered as od
from ..operators import relational as rel

QUATERNION, TRANSLATION = ("qw", "qx", "qy", "qz"), ("tx", "ty", "tz")


def with_centres(images: DataFrame) -> DataFrame:
    """Adds the camera centre (cx, cy, cz) and the viewing axis (ax, ay, az)."""
    r = cam.rotation(*[F.col(c) for c in QUATERNION])
    c, a = cam.centre(r, tuple(F.col(x) for x in TRANSLATION)), cam.axis(r)
    return images.select("*", *[v.alias(n) for v, n in zip((*c, *a), ("cx", "cy", "cz", "ax", "ay", "az"))])


def face_views(images: DataFrame, cameras: DataFrame, disk: DataFrame) -> DataFrame:
    """Faces by name whose camera is known and no SPHERE and whose file exists, with face, frame and centres."""
    named = images.withColumn("frame", frame_of(F.col("name"))).withColumn("face", face_of(F.col("name"))).filter("frame is not null")
    flat = cameras.filter("model <> 'SPHERE'").select("camera_id")
    return with_centres(rel.present(rel.present(named, flat, "camera_id"), disk, "name"))


def repair_candidates(faces: DataFrame, match: bool = True) -> DataFrame:
    """Faces away from the common viewpoint with their distance to it and, with match, the pristine face that looks most the
    same way (reference) and the angle to it in degrees. The order is by face and frame."""
    size = agg.extent(faces, ["cx", "cy", "cz"]).first()[0]
    edge = max(size * 1e-4, 1e-6)
    order = F.struct("face", "frame", "name")
    spot = agg.densest_bucket(faces.withColumn("_ord", order), ["cx", "cy", "cz"], edge, "_ord").select(*[F.col(c).alias(f"_{c}") for c in ("cx", "cy", "cz")])
    near = faces.crossJoin(F.broadcast(spot))  # one row
    near = near.withColumn("dist", F.sqrt(sum((F.col(c) - F.col(f"_{c}")) ** 2 for c in ("cx", "cy", "cz"))))
    same = reduce(lambda a, b: a & b, [F.rint(F.col(c) / edge) == F.rint(F.col(f"_{c}") / edge) for c in ("cx", "cy", "cz")])
    pool, rest = near.filter(same), near.filter(~same).drop("_cx", "_cy", "_cz")
    if not match:
        return rest
    vector = lambda d: d.withColumn("axis", F.array("ax", "ay", "az"))
    found = rel.nearest_by_cosine(vector(rest), vector(pool).withColumn("reference", F.col("name")), "name", "axis", "reference")
    return rest.join(found, "name", "left").withColumn("ref_angle", cam.angle_degrees(F.col("cosine"))).drop("cosine")


def select_repairs(candidates: DataFrame, sharpness: DataFrame, method: str, max_frames: int = 200, every: int = 8, threshold: float | None = 8.0) -> DataFrame:
    """The repair list: candidates with sharp enough references (their own sharpness where they have none), ranked.

    rank_by_damage: ascending ratio of own to reference sharpness (1 when unusable); furthest: descending distance;
    every_nth: every n-th in camera order, without a cap."""
    own = sharpness.select("name", F.col("sharpness").alias("_own"))
    theirs = sharpness.select(F.col("name").alias("reference"), F.col("sharpness").alias("_ref"))
    c = candidates if "reference" in candidates.columns else candidates.withColumn("reference", F.lit(None).cast("string"))
    c = c.join(own, "name", "left").join(theirs, "reference", "left")
    if threshold is not None:
        c = c.filter(F.coalesce("_ref", "_own", F.lit(0.0)) >= threshold)
    c = c.withColumn("ratio", F.when(F.col("_ref") > 1e-6, F.col("_own") / F.col("_ref")).otherwise(1.0)).drop("_own", "_ref")
    if method == "rank_by_damage":
        return od.rank_by_damage(c, "ratio", ["face", "frame"], max_frames)
    if method == "furthest":
        return od.rank_by_displacement(c, "dist", ["face", "frame"], max_frames)
    if method == "every_nth":
        return od.every_nth(c, ["face", "frame"], every)
    raise ValueError(f"unknown method {method}")


def covered_faces(faces: DataFrame, hires: DataFrame, cameras: DataFrame, distance: float, samples: int = 7, margin: float = 8.0) -> DataFrame:
    """(name, coverage): the share of each face's sample rays inside any high-resolution view near it; faces without such a
    view have 0. Faces and views meet by cells of `distance`, so far ones are never paired."""
    lens = cameras.select("camera_id", F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"), cam.intrinsics(F.col("model"), F.col("params")).alias("k")).filter("k is not null")
    a = faces.select("name", "camera_id", *QUATERNION, "cx", "cy", "cz").join(lens, "camera_id")
    b = with_centres(hires.select("name", "camera_id", *QUATERNION, *TRANSLATION)).join(lens, "camera_id")
    b = b.select(*[F.col(c).alias(f"v_{c}") for c in ("name", *QUATERNION, "cx", "cy", "cz", "w", "h", "k")])
    pairs = rel.distance_join(a, b, [(c, f"v_{c}") for c in ("cx", "cy", "cz")], distance)
    from ..operators.raster import coverage, inside_view, ray_grid

    rays = ray_grid(pairs, samples, "w", "h")
    local = ((F.col("px") - F.col("k.cx")) / F.col("k.fx"), (F.col("py") - F.col("k.cy")) / F.col("k.fy"), F.lit(1.0))
    r = cam.rotation(*[F.col(c) for c in QUATERNION])
    world = tuple(r[0][i] * local[0] + r[1][i] * local[1] + r[2][i] * local[2] for i in range(3))
    v = cam.rotation(*[F.col(f"v_{c}") for c in QUATERNION])
    x, y, z = (cam.dot(v[i], world) for i in range(3))
    hit = inside_view(x, y, z, F.col("v_k.fx"), F.col("v_k.fy"), F.col("v_k.cx"), F.col("v_k.cy"), F.col("v_w"), F.col("v_h"), margin)
    found = coverage(rays, "name", ["px", "py"], hit)
    return faces.select("name").join(found, "name", "left").select("name", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def select_pruned(faces: DataFrame, coverage: DataFrame, mode: str = "covered", least: float = 0.4, ring: int = 4, protected: list[int] = [0], most_share: float = 0.6) -> DataFrame:  # noqa: B006
    """Names of the faces to remove. covered: each with enough coverage; viewpoint: whole frames of which `ring` faces have it.
    Protected frames stay; removing more than most_share of all faces fails."""
    c = faces.join(coverage, "name").filter(~F.col("frame").isin(protected))
    hit = F.col("coverage") >= least
    out = c.filter(hit) if mode == "covered" else agg.whole_group_rule(c, "frame", hit, ring)
    gone, total = out.count(), faces.count()
    if total and gone / total > most_share:
        raise ValueError(f"would remove {gone} of {total} faces")
    return out.select("name")


def apply_removal(cameras: DataFrame, images: DataFrame, tracks: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The model without the images named: their track elements go, points stay though empty, and cameras nobody uses go."""
    left = rel.orphans(images, gone, "name")
    lost = rel.present(images, gone, "name").select("image_id")
    return {"cameras": rel.present(cameras, left, "camera_id"), "images": left, "tracks": rel.orphans(tracks, lost, "image_id")}


def trim_model(cameras: DataFrame, images: DataFrame, points: DataFrame, tracks: DataFrame, observations: DataFrame, keep: DataFrame) -> dict[str, DataFrame]:
    """The model of the images kept: their cameras, the points that any of them sees, and observations of other points as -1."""
    left = rel.present(images, keep, "name")
    kept_tracks = rel.present(tracks, left, "image_id")
    kept_points = rel.present(points, kept_tracks, "point3d_id")
    seen = rel.dangling_to(rel.present(observations, left, "image_id"), kept_points, "point3d_id")
    return {"cameras": rel.present(cameras, left, "camera_id"), "images": left, "points": kept_points, "tracks": kept_tracks, "observations": seen}


def append_model(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Both models in one: new camera, image and point ids move beyond the old maxima, and so do all references to them."""
    top = lambda t, c: old[t].agg(F.coalesce(F.max(c), F.lit(0))).first()[0]
    shift = {"camera_id": top("cameras", "camera_id"), "image_id": top("images", "image_id"), "point3d_id": top("points", "point3d_id")}
    out = {}
    for t, d in new.items():
        for c, n in shift.items():
            if c in d.columns:
                d = d.withColumn(c, F.when(F.col(c) >= 0, F.col(c) + n).otherwise(F.col(c)).cast(old[t].schema[c].dataType))
        out[t] = old[t].unionByName(d.select(*old[t].columns))
    return out


def rebuild(cameras: DataFrame, images: DataFrame, observations: DataFrame, tracks: DataFrame, disk: DataFrame, poses: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """A consistent model of what is on disk.

    Faces of the first model that have a file keep their ids; where the file's size differs, camera and observations are
    rescaled. High-resolution views of the pose model (cameras, images) that have a file follow with new ids and no
    observations. Equal cameras (parameters to 6 decimals) share an id, numbered by first use, faces first. Points stay;
    track elements of faces that are gone go."""
    sizes = disk.select("name", F.col("width").alias("_w"), F.col("height").alias("_h"))
    named = images.filter(frame_of(F.col("name")).isNotNull()).join(cameras, "camera_id").join(sizes, "name")
    sx, sy = F.col("_w") / F.col("width"), F.col("_h") / F.col("height")
    other = (F.col("_w") != F.col("width")) | (F.col("_h") != F.col("height"))
    fit = lambda d: d.withColumn("_s", F.when(other, cam.rescaled(F.col("model"), F.col("params"), sx, sy)).otherwise(F.struct("model", "params"))).withColumn("sx", F.when(other, sx).otherwise(1.0)).withColumn("sy", F.when(other, sy).otherwise(1.0))
    cols = ["image_id", *QUATERNION, *TRANSLATION, "name"]
    made = lambda d, part: fit(d).select(*cols, "sx", "sy", F.col("_s.model").alias("model"), F.col("_s.params").alias("params"), F.coalesce("_w", "width").cast("long").alias("width"), F.coalesce("_h", "height").cast("long").alias("height"), F.lit(part).alias("part"))
    kept = made(named, 0)
    if poses:
        views = poses[1].filter(hires_of(F.col("name")).isNotNull() & frame_of(F.col("name")).isNull()).join(poses[0].filter("model <> 'SPHERE'"), "camera_id").join(sizes, "name")
        top = images.agg(F.coalesce(F.max("image_id"), F.lit(0))).first()[0]
        views = od.with_position(views.drop("image_id"), ["name"], "_n").withColumn("image_id", (F.col("_n") + top + 1).cast("int"))
        kept = kept.unionByName(made(views, 1))
    signature = [F.col("model"), F.col("width"), F.col("height"), F.transform("params", lambda x: F.round(x, 6))]
    kept = od.held(rel.dense_ids(kept.withColumn("_ord", F.struct("part", "image_id")), signature, "_ord", "camera_id"))
    scaled = observations.join(kept.filter("part = 0").select("image_id", "sx", "sy"), "image_id")
    return {
        "cameras": kept.select("camera_id", "model", "width", "height", "params").dropDuplicates(["camera_id"]),
        "images": kept.select(*cols, "camera_id"),
        "observations": scaled.select("image_id", "idx", (F.col("x") * F.col("sx")).alias("x"), (F.col("y") * F.col("sy")).alias("y"), "point3d_id"),
        "tracks": rel.present(tracks, kept.filter("part = 0"), "image_id"),
    }


def check_alignment(faces: DataFrame, spheres: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(deviation, allowed, aligned): the largest difference of face and panorama centres of one frame."""
    j = faces.select("frame", "cx", "cy", "cz").join(spheres.select("frame", *[F.col(c).alias(f"s{c}") for c in ("cx", "cy", "cz")]), "frame")
    worst = j.agg(F.coalesce(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"s{c}")) for c in ("cx", "cy", "cz")])), F.lit(0.0)).alias("deviation"))
    allowed = agg.extent(faces, ["cx", "cy", "cz"]).select((F.greatest("extent", F.lit(1e-9)) * tolerance).alias("allowed"))
    return worst.crossJoin(allowed).select("deviation", "allowed", (F.col("deviation") <= F.col("allowed")).alias("aligned"))


def stride_split(sequences: DataFrame, present: DataFrame, every: int, drop_partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """Kept and skipped names of (seq_id, pos, name) sequences, of those present."""
    if every < 2:
        raise ValueError("every must be 2 or more")
    there = rel.present(sequences, present, "name")
    kept = od.stride_group(there, ["seq_id"], ["pos"], every, drop_partial)
    return kept, rel.orphans(there, kept, "name")


def camera_sequences(images: DataFrame, trajectories: DataFrame) -> DataFrame:
    """(face, traj, names): faces' names by face and trajectory, in order of frame and name; trajectories has traj and size."""
    named = images.select("name", frame_of(F.col("name"), False).alias("frame"), face_of(F.col("name"), False).alias("face")).filter("face is not null")
    placed = od.in_bounds(named, "frame", od.cumulative_bounds(trajectories, "traj", "size"), "traj")
    return placed.groupBy("face", "traj").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "name"))), lambda x: x["name"]).alias("names"))


def upscale_order(sequences: DataFrame, present: DataFrame) -> DataFrame:
    """(group_id, pos, name): a marker's sequences of the names that are present, each name where it stands first; names in no
    sequence are a last group by name."""
    first = od.first_per_key(rel.present(sequences.select("name", "seq_id", "pos"), present, "name"), ["name"], ["seq_id", "pos"])
    extra = od.with_position(rel.orphans(present.select("name"), sequences, "name"), ["name"], "pos").withColumn("pos", F.col("pos") + 1)
    last = sequences.agg((F.coalesce(F.max("seq_id"), F.lit(-1)) + 1).alias("g"))
    extra = extra.crossJoin(F.broadcast(last)).select(F.col("g").alias("seq_id"), "pos", "name")
    return first.select("seq_id", "pos", "name").unionByName(extra).withColumnRenamed("seq_id", "group_id")


def upscale_plan(order: DataFrame, every: int = 1, drop_partial: bool = False, most_batch: int = 0, view: int | None = None) -> DataFrame:
    """(views, frames, uniform, per_view, batch, chunks, tail) of an upscale order (group_id, pos, name): how to cut it into
    batches that never straddle two views.

    Views are the groups that keep a frame after the stride; `view` picks one by its place in the order and raises IndexError
    where there is none. per_view is the greatest common divisor of their sizes, batch its largest divisor of the form 4k + 1
    up to most_batch (0: no limit), or the largest 4k + 1 within both; chunks whole batches fit a view, tail frames are left."""
    if view is not None:
        first = od.first_per_key(order.select("group_id"), ["group_id"], ["group_id"])
        picked = od.with_position(first, ["group_id"], "_view").filter(F.col("_view") == view)
        if picked.isEmpty():
            raise IndexError(f"there is no view {view}")
        order = order.join(F.broadcast(picked.select("group_id")), "group_id")  # one row
    kept = od.stride_group(order, ["group_id"], ["pos"], every, drop_partial) if every > 1 else order
    sizes = od.held(kept.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.count(F.lit(1)).alias("views"), F.coalesce(F.sum("n"), F.lit(0)).alias("frames"), (F.min("n") == F.max("n")).alias("uniform"))
    per_view = agg.common_divisor(sizes, "n").withColumnRenamed("gcd", "per_view")
    plan = total.join(per_view.withColumn("per_view", F.col("per_view").cast("int")))  # a row each; none where nothing is kept
    cap = F.lit(most_batch) if most_batch > 0 else F.col("per_view")
    plan = plan.withColumn("batch", batch_size(F.col("per_view"), cap).cast("int"))
    return plan.select("views", "frames", "uniform", "per_view", "batch", F.floor(F.col("per_view") / F.col("batch")).cast("int").alias("chunks"), (F.col("per_view") % F.col("batch")).cast("int").alias("tail"))
