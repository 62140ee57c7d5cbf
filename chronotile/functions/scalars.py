"""Scalar functions over columns: report types, names, paths, formats, roles, geometry of boxes and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronotile.functions.geodesy import let

# Report types with their keywords, in the order in which they are tried.
CHANGE_TYPES = (
    ("Demolition", ("demolition", "clearing", "removed", "debris")),
    ("Extension", ("expansion", "widening", "extension", "renovation", "addition")),
    ("Vegetation Change", ("vegetation", "tree", "forest", "green", "crop")),
    ("New Construction", ("construction", "building", "structure", "road", "pavement", "temporary", "roof", "concrete", "foundation")),
    ("Other", ("water", "bare", "soil", "land", "unclassified")),
)
RESERVED = ("images", "thumbs", "cache", "legacy")
IMAGE_EXTENSIONS = (".tif", ".tiff", ".png", ".jpg", ".jpeg")
ROLES = ("viewer", "uploader", "analyst", "admin")
NODE_TYPES = ("zone", "village", "area", "folder")
METRES_PER_DEGREE = 111320.0


def change_type(label: Column) -> Column:
    """Report type of a class label; the first type one of whose words it contains, then "new", else Other."""
    low = F.lower(F.coalesce(label, F.lit("")))
    out = None
    for name, words in CHANGE_TYPES:
        test = low.rlike("|".join(words))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(low.contains("new"), "New Construction").otherwise("Other")


_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def slug(name: Column, fallback: str = "node") -> Column:
    """File-system name: letters of Western alphabets without accents, other non-ASCII dropped, runs of blanks and dashes one underscore."""
    plain = F.regexp_replace(F.translate(F.trim(F.coalesce(name, F.lit(""))), _ACCENTED, _PLAIN), r"[^\x00-\x7F]", "")
    joined = F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9_\s-]", ""), r"[\s_-]+", "_")
    lower = F.lower(F.regexp_replace(joined, "^_+|_+$", ""))
    named = let(lower, lambda text: F.when(text == "", fallback).otherwise(text))  # a long text goes through its patterns once
    return let(named, lambda text: F.substring(F.when(text.isin(*RESERVED), F.concat(text, F.lit("_1"))).otherwise(text), 1, 64))


def numbered(base: Column, place: Column) -> Column:
    """The place-th use of a name among siblings: itself, then -2, -3 ..."""
    return F.when(place == 1, base).otherwise(F.substring(F.concat(base, F.lit("-"), place.cast("string")), 1, 64))


def report_name(title: Column, run_id: Column) -> Column:
    """Safe report name of at most 60 characters."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^A-Za-z0-9 _-]", "_"), " ", "_")
    return F.concat(F.lit("report_"), run_id.cast("string"), F.lit("_"), F.substring(safe, 1, 60))


def library_path(path: Column) -> Column:
    """Path with forward slashes and no leading one; null if a part of it leads upwards."""
    clean = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "^/+", "")
    return F.when(~F.exists(F.split(clean, "/"), lambda p: p == ".."), clean)


def cache_key(path: Column) -> Column:
    """Name of a cached preview."""
    return F.substring(F.sha2(path, 256), 1, 32)


def node_type(depth: Column) -> Column:
    """Type of a tree node by depth, the last for all deeper ones."""
    return F.element_at(F.array(*map(F.lit, NODE_TYPES)), F.least(depth, F.lit(3)) + 1)


def image_owner(path: Column) -> Column:
    """Folder that owns an image folder: trailing reserved parts removed."""
    return F.regexp_replace(path, "(?i)(/(" + "|".join(RESERVED) + "))+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    """Whether the extension is one of an image."""
    return extension(path).isin(*IMAGE_EXTENSIONS)


def image_type(path: Column) -> Column:
    """GeoTIFF for .tif and .tiff, else the extension's own name, or other."""
    e = extension(path)
    return F.when(e.isin(".tif", ".tiff"), "GeoTIFF").when(e == ".png", "PNG").when(e.isin(".jpg", ".jpeg"), "JPEG").otherwise("other")


def is_geotiff(path: Column) -> Column:
    """X21."""
    return path.rlike(r"(?i)\.tiff?$")


def local_iso(ts: Column) -> Column:
    """UTC time as ISO 8601 at +05:30."""
    return F.concat(F.date_format(ts + F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))


def parsed_date(text: Column) -> Column:
    """X11: ISO time, or else date; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def is_email(text: Column) -> Column:
    """X12."""
    return text.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def is_year_folder(name: Column) -> Column:
    """Four digits from 1990 to 2100."""
    return F.coalesce(name.rlike("^[0-9]{4}$") & name.try_cast("int").between(1990, 2100), F.lit(False))


def clamped_parameters(sensitivity: Column, least_area: Column, preview: Column) -> Column:
    """Struct of detection parameters within their bounds; M23's numeric settings use the same clamps."""
    between = lambda v, a, b: F.least(F.greatest(v, F.lit(a)), F.lit(b))
    return F.struct(between(sensitivity, 0.0, 1.0).alias("sensitivity"), between(least_area, 50, 10000).alias("least_area"), between(preview, 256, 4096).alias("preview"))


def job_progress(status: Column, engine: Column) -> Column:
    """Engine percent in 15..78 of a running job, else by status."""
    return F.when(status == "completed", 100).when(status == "failed", 100).when(status == "queued", 0).otherwise(15 + (engine * 0.63).cast("int"))


def location_label(*parts: Column) -> Column:
    """Non-empty parts, joined."""
    return F.concat_ws(" / ", *[F.nullif(p, F.lit("")) for p in parts])


def compact_number(n: Column) -> Column:
    """950, 1.2K, 3.4M, 1234.5M: one digit after the point, halves to even, no grouping marks."""
    tenths = lambda v: F.replace(F.format_number(v, 1), F.lit(","), F.lit(""))
    return F.when(n >= 1000000, F.concat(tenths(n / 1000000), F.lit("M"))).when(n >= 1000, F.concat(tenths(n / 1000), F.lit("K"))).otherwise(n.cast("string"))


def log2(v: Column) -> Column:
    """The binary logarithm, minus infinity at 0; null below."""
    return F.when(v == 0, F.lit(float("-inf"))).otherwise(F.log2(v))


def session_address(session: Column) -> Column:
    """Guest address of a session id; only letters, digits, dashes and underscores stay, 40 at most."""
    return F.concat(F.lit("guest-"), F.substring(F.regexp_replace(session, "[^A-Za-z0-9_-]", ""), 1, 40), F.lit("@local"))


def role_rank(role: Column) -> Column:
    """Rank of a role, 0 for an unknown one."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), role), F.lit(0)).cast("int")


def percent_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box in percent of the picture."""
    part = lambda v, of: F.round(100.0 * v / of, 4)
    return F.struct(part(x, width).alias("left"), part(y, height).alias("top"), part(w, width).alias("width"), part(h, height).alias("height"))


def bounds_struct(text: Column) -> Column:
    """G1: struct<west, south, east, north> of a JSON object, a JSON list, or four numbers and commas; null for anything else."""
    obj = F.from_json(text, "west double, south double, east double, north double")
    four = F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ",")
    nums = F.transform(four, lambda v: v.try_cast("double"))
    listed = F.when((F.size(four) == 4) & F.forall(nums, lambda v: v.isNotNull()), F.struct(nums[0].alias("west"), nums[1].alias("south"), nums[2].alias("east"), nums[3].alias("north")))
    whole = obj["west"].isNotNull() & obj["south"].isNotNull() & obj["east"].isNotNull() & obj["north"].isNotNull()
    return F.when(text.startswith("{"), F.when(whole, obj)).otherwise(listed)


def bounds_valid(b: Column) -> Column:
    """G2."""
    return b["west"].between(-180, 180) & b["east"].between(-180, 180) & b["south"].between(-90, 90) & b["north"].between(-90, 90)


def bounds_json(b: Column) -> Column:
    """G10."""
    return F.to_json(b)


def affine_lng_lat(x: Column, y: Column, t: Column, scale_x: Column, scale_y: Column) -> Column:
    """struct<lng, lat> of the centre of a detection pixel under an affine transform a..f in degrees."""
    px, py = x * scale_x + 0.5, y * scale_y + 0.5
    return F.struct((t["a"] * px + t["b"] * py + t["c"]).alias("lng"), (t["d"] * px + t["e"] * py + t["f"]).alias("lat"))


def lat_lng(x: Column, y: Column, width: Column, height: Column, b: Column, affine: Column | None = None) -> Column:
    """struct<lat, lng> to 6 places: the affine place if it is on earth, else linear between the bounds."""
    linear = F.struct(F.round(b["north"] - y / height * (b["north"] - b["south"]), 6).alias("lat"), F.round(b["west"] + x / width * (b["east"] - b["west"]), 6).alias("lng"))
    out = F.when((width > 0) & (height > 0) & b.isNotNull(), linear)
    if affine is None:
        return out
    sound = affine.isNotNull() & (F.abs(affine["lat"]) <= 90) & (F.abs(affine["lng"]) <= 180) & (width > 0) & (height > 0)
    return F.when(sound, F.struct(F.round(affine["lat"], 6).alias("lat"), F.round(affine["lng"], 6).alias("lng"))).otherwise(out)


def box_square_metres(w: Column, h: Column, width: Column, height: Column, b: Column) -> Column:
    """Area of a box, by degrees at the middle latitude, to 1 place."""
    middle = F.cos(F.radians((b["north"] + b["south"]) / 2))
    wide = w * (F.abs(b["east"] - b["west"]) / width) * (METRES_PER_DEGREE * middle)
    high = h * (F.abs(b["north"] - b["south"]) / height) * METRES_PER_DEGREE
    return F.when((width > 0) & (height > 0), F.round(wide * high, 1))


def world_file(text: Column, width: Column, height: Column) -> Column:
    """struct<a..f, west, south, east, north> of a world file's six lines; the stored centre of the first pixel becomes its corner."""
    numbers = F.transform(F.slice(F.split(F.trim(text), r"\s+"), 1, 6), lambda v: v.try_cast("double"))

    def box(p: Column) -> Column:
        a, d, b, e, c, f = (p[k] for k in "adbecf")
        xs = [c, c + a * width, c + b * height, c + a * width + b * height]
        ys = [f, f + d * width, f + e * height, f + d * width + e * height]
        return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), e.alias("e"), f.alias("f"), F.least(*xs).alias("west"), F.least(*ys).alias("south"), F.greatest(*xs).alias("east"), F.greatest(*ys).alias("north"))

    def read(n: Column) -> Column:
        good = (F.size(n) == 6) & F.forall(n, lambda v: v.isNotNull())
        corner = F.struct(n[0].alias("a"), n[1].alias("d"), n[2].alias("b"), n[3].alias("e"), (n[4] - n[0] / 2 - n[2] / 2).alias("c"), (n[5] - n[1] / 2 - n[3] / 2).alias("f"))
        return F.when(good, let(corner, box))

    return let(numbers, read)  # the text is read once, however often its numbers are used


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes struct<x, y, w, h>."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = w * h
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def severity(object_type: Column, area: Column, confidence: Column, total: Column) -> Column:
    """Minor, moderate or major, by three formulas: vegetation, built, other."""

    def graded(per_area: float, per_confidence: float, moderate: float, major: float) -> Column:
        score = area / total * per_area + confidence * per_confidence
        return F.when(score < moderate, "minor").when(score < major, "moderate").otherwise("major")

    kind = F.coalesce(object_type, F.lit(""))
    built = kind.isin("New Construction/Building", "Demolition/Clearing", "Road/Pavement Change", "Temporary Structure")
    return F.when(total <= 0, "minor").when(kind.contains("Vegetation"), graded(600, 0.6, 0.8, 3.0)).when(built, graded(1200, 0.4, 1.2, 4.5)).otherwise(graded(1000, 0.3, 1.0, 4.0))


def vehicle_area_limit(image_area: Column) -> Column:
    """R10."""
    return F.when(image_area > 0, F.least(F.greatest(image_area * 0.00028, F.lit(6000.0)), F.lit(50000.0)).cast("int")).otherwise(35000)
