"""Fixed dictionaries: image types, option names, gravities, tag tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Image types, in registration order, with their capabilities.
TYPE_FIELDS = (
    "format", "ext", "mime", "vector", "alpha", "icc", "quality", "anim_load", "anim_save", "thumbnail", "hdr",
)
IMAGE_TYPES = (
    ("jpeg", ".jpg", "image/jpeg", False, False, True, True, False, False, False, False),
    ("jxl", ".jxl", "image/jxl", False, True, True, True, True, False, False, True),
    ("png", ".png", "image/png", False, True, True, False, False, False, False, True),
    ("webp", ".webp", "image/webp", False, True, True, True, True, True, False, False),
    ("gif", ".gif", "image/gif", False, True, False, False, True, True, False, False),
    ("ico", ".ico", "image/x-icon", False, True, False, False, False, False, False, False),
    ("svg", ".svg", "image/svg+xml", True, True, False, False, False, False, False, False),
    ("heic", ".heic", "image/heif", False, True, True, True, False, False, True, False),
    ("avif", ".avif", "image/avif", False, True, True, True, False, False, True, True),
    ("bmp", ".bmp", "image/bmp", False, True, False, False, False, False, False, False),
    ("tiff", ".tiff", "image/tiff", False, True, True, True, False, False, False, True),
)
TYPE_NAMES = tuple(row[0] for row in IMAGE_TYPES)
TYPE_ALIASES = {"jpg": "jpeg"}

# Types with an encoder; every listed type has a decoder.
SAVEABLE = ("jpeg", "jxl", "png", "webp", "gif", "ico", "heic", "avif", "bmp", "tiff")

# Output defaults.
PREFERRED_FORMATS = ("jpeg", "png", "gif")
DEFAULT_QUALITY = 80
DEFAULT_FORMAT_QUALITY = {"webp": 79, "avif": 63, "jxl": 77}
MAX_SRC_RESOLUTION = 50_000_000
DEFAULT_TTL = 31_536_000

RESIZE_TYPES = ("fit", "fill", "fill-down", "force", "auto")
COMPASS = ("ce", "no", "ea", "so", "we", "nowe", "noea", "sowe", "soea")
CROP_GRAVITIES = COMPASS + ("sm", "fp")
EXTEND_GRAVITIES = COMPASS + ("fp",)
WATERMARK_GRAVITIES = COMPASS + ("re",)

# Option name -> short names.
OPTION_ALIASES = {
    "resize": ("rs",),
    "size": ("s",),
    "resizing_type": ("rt",),
    "width": ("w",),
    "height": ("h",),
    "min-width": ("mw",),
    "min-height": ("mh",),
    "zoom": ("z",),
    "dpr": (),
    "enlarge": ("el",),
    "extend": ("ex",),
    "extend_aspect_ratio": ("extend_ar", "exar"),
    "gravity": ("g",),
    "crop": ("c",),
    "trim": ("t",),
    "padding": ("pd",),
    "auto_rotate": ("ar",),
    "rotate": ("rot",),
    "flip": ("fl",),
    "background": ("bg",),
    "blur": ("bl",),
    "sharpen": ("sh",),
    "pixelate": ("pix",),
    "watermark": ("wm",),
    "strip_metadata": ("sm",),
    "keep_copyright": ("kcr",),
    "strip_color_profile": ("scp",),
    "preserve_hdr": ("ph",),
    "enforce_thumbnail": ("eth",),
    "quality": ("q",),
    "format_quality": ("fq",),
    "max_bytes": ("mb",),
    "format": ("f", "ext"),
    "skip_processing": ("skp",),
    "raw": (),
    "cachebuster": ("cb",),
    "expires": ("exp",),
    "filename": ("fn",),
    "return_attachment": ("att",),
    "preset": ("pr",),
    "max_src_resolution": ("msr",),
    "max_src_file_size": ("msfs",),
    "max_animation_frames": ("maf",),
    "max_animation_frame_resolution": ("mafr",),
    "max_result_dimension": ("mrd",),
}
CANONICAL = {name: name for name in OPTION_ALIASES} | {
    short: name for name, shorts in OPTION_ALIASES.items() for short in shorts
}
SECURITY_OPTIONS = (
    "max_src_resolution",
    "max_src_file_size",
    "max_animation_frames",
    "max_animation_frame_resolution",
    "max_result_dimension",
)

# Camera-RAW file extensions and MIME types that share the TIFF magic.
RAW_EXTENSIONS = (
    ".3fr", ".adng", ".arw", ".cap", ".cr2", ".cr3", ".crw", ".data", ".dcr", ".dng", ".eip", ".erf", ".fff",
    ".gpr", ".iiq", ".k25", ".kdc", ".mef", ".moc", ".mos", ".mdc", ".mrw", ".nef", ".nrw", ".orf", ".ori",
    ".pef", ".ppm", ".proraw", ".raf", ".raw", ".rw2", ".rwl", ".sr2", ".srf", ".srw", ".x3f",
)
RAW_MIME_TYPES = (
    "image/x-hasselblad-3fr", "image/x-adobe-dng", "image/x-sony-arw", "image/x-phaseone-cap",
    "image/x-canon-cr2", "image/x-canon-cr3", "image/x-canon-crw", "image/x-kodak-dcr", "image/x-epson-erf",
    "image/x-hasselblad-fff", "image/x-gopro-gpr", "image/x-phaseone-iiq", "image/x-kodak-k25",
    "image/x-kodak-kdc", "image/x-mamiya-mef", "image/x-leaf-mos", "image/x-minolta-mrw", "image/x-nikon-nef",
    "image/x-nikon-nrw", "image/x-olympus-orf", "image/x-sony-ori", "image/x-pentax-pef",
    "image/x-apple-proraw", "image/x-fuji-raf", "image/x-raw", "image/x-panasonic-rw2", "image/x-leica-rwl",
    "image/x-sony-sr2", "image/x-sony-srf", "image/x-samsung-srw", "image/x-sigma-x3f",
)


def image_types(spark: SparkSession) -> DataFrame:
    """The 11-row type dimension; its size never grows, so it may be broadcast."""
    schema = ", ".join(f"{f} {'string' if i < 3 else 'boolean'}" for i, f in enumerate(TYPE_FIELDS))
    return spark.createDataFrame(list(IMAGE_TYPES), schema)


def types_where(field: str) -> list[str]:
    """Names of the types that have a capability."""
    at = TYPE_FIELDS.index(field)
    return [row[0] for row in IMAGE_TYPES if row[at]]


def has_capability(fmt: Column, field: str) -> Column:
    """Whether the type has the capability; an unknown type has none."""
    return F.coalesce(fmt.isin(*types_where(field)), F.lit(False))


def type_name(text: Column) -> Column:
    """Canonical type name of an option argument or extension, else NULL."""
    named = F.when(text.isin(*TYPE_NAMES), text)
    for alias, name in TYPE_ALIASES.items():
        named = named.when(text == alias, F.lit(name))
    return named
