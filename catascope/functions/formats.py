"""Format lists the openness metrics compare with, and the media type registry."""

from __future__ import annotations

# Formats that can be read by machines.
MACHINE_READABLE = [
    "cdf", "csv", "csv.zip", "esri shapefile", "geojson", "iati", "ical", "ics", "json", "kml",
    "kmz", "netcdf", "nt", "ods", "psv", "psv.zip", "rdf", "rdfa", "rss", "shapefile", "shp",
    "shp.zip", "sparql", "sparql web form", "tsv", "ttl", "wms", "xlb", "xls", "xls.zip", "xlsx",
    "xml", "xml.zip",
]

# Formats that are not proprietary.
OPEN_FORMATS = [
    "dvi", "svg",
    "ascii", "audio/mpeg", "bmp", "cdf", "csv", "csv.zip", "dbf", "geojson", "geotiff", "gzip",
    "html", "iati", "ical", "ics", "jpeg 2000", "json", "kml", "kmz", "mpeg", "netcdf", "nt",
    "ods", "pdf", "pdf/a", "png", "psv", "psv.zip", "rdf", "rdfa", "rss", "rtf", "sparql",
    "sparql web form", "tar", "tiff", "tsv", "ttl", "txt", "wms", "wfs", "xml", "xml.zip", "zip",
]

# Own small registry for sessions without the landed registry files: suffix -> media type.
# sources.registries.read_media_types reads the full one.
COMMON_MEDIA_TYPES = {
    "avi": "video/x-msvideo",
    "csv": "text/csv",
    "css": "text/css",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "geojson": "application/geo+json",
    "gif": "image/gif",
    "gml": "application/gml+xml",
    "gz": "application/gzip",
    "htm": "text/html",
    "html": "text/html",
    "ics": "text/calendar",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "js": "text/javascript",
    "json": "application/json",
    "jsonld": "application/ld+json",
    "kml": "application/vnd.google-earth.kml+xml",
    "kmz": "application/vnd.google-earth.kmz",
    "mp4": "video/mp4",
    "mpeg": "video/mpeg",
    "n3": "text/n3",
    "nt": "application/n-triples",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odt": "application/vnd.oasis.opendocument.text",
    "pdf": "application/pdf",
    "png": "image/png",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "rdf": "application/rdf+xml",
    "rtf": "application/rtf",
    "svg": "image/svg+xml",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "tsv": "text/tab-separated-values",
    "ttl": "text/turtle",
    "txt": "text/plain",
    "wav": "audio/wav",
    "xhtml": "application/xhtml+xml",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xml": "application/xml",
    "zip": "application/zip",
}
# Types in wide use without a registration.
UNREGISTERED = {"video/x-msvideo", "audio/wav"}


def common_registry() -> list[str]:
    """Names, media types and suffixes of the own registry, lower case."""
    known = {s: t for s, t in COMMON_MEDIA_TYPES.items() if t not in UNREGISTERED}
    names = {t.split("/", 1)[1] for t in known.values()}
    return sorted(set(known) | set(known.values()) | names)
