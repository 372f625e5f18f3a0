"""Request builders of the open-data services: pure functions, no network."""

from __future__ import annotations

import math
from decimal import Decimal
from urllib.parse import quote
from xml.etree import ElementTree

from ..core import BBox

# The services' limits, addresses and axis orders.
WMS_CAP, WFS_CAP = 5010, 10000
WMS_RASTER = "https://data.geopf.fr/wms-r/wms"
LAT_FIRST = ("ortho", "dem", "cosia")


def wms_size(box: BBox, res: float = 1.0, cap: int = WMS_CAP) -> tuple[int, int]:
    lat = math.radians((box.min_y + box.max_y) / 2)
    return capped((box.max_x - box.min_x) * 40075000.0 * math.cos(lat) / 360.0 / res, (box.max_y - box.min_y) * 111320.0 / res, cap)


def capped(width: float, height: float, cap: int = WMS_CAP) -> tuple[int, int]:
    """Whole pixels; if a side is over the cap both shrink alike, to 1 at least."""
    w, h = int(width), int(height)
    scale = max(w / cap, h / cap)
    return (w, h) if scale <= 1 else (max(int(w / scale), 1), max(int(h / scale), 1))


def wms_url(layer: str, box: BBox, key: str, res: float = 1.0) -> str:
    w, h = wms_size(box, res)
    sides = (box.min_y, box.min_x, box.max_y, box.max_x) if key in LAT_FIRST else (box.min_x, box.min_y, box.max_x, box.max_y)
    return f"{WMS_RASTER}?LAYERS={layer}&FORMAT=image/geotiff&SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&STYLES=&CRS=EPSG:4326&BBOX={','.join(f'{s:g}' if s == int(s) else repr(s) for s in sides)}&WIDTH={w}&HEIGHT={h}"


# Namespaces and names of the filter that the services read.
OGC, GML = "http://www.opengis.net/ogc", "http://www.opengis.net/gml"


def bbox_filter_xml(box: BBox, geometry: str = "Geometry", srs: str = "EPSG:4326") -> str:
    """A filter of the features in a box; latitude comes first in its corners."""
    ElementTree.register_namespace("ogc", OGC)
    ElementTree.register_namespace("gml", GML)
    top = ElementTree.Element(f"{{{OGC}}}Filter")
    inside = ElementTree.SubElement(top, f"{{{OGC}}}Bbox")
    ElementTree.SubElement(inside, f"{{{OGC}}}PropertyName").text = geometry
    envelope = ElementTree.SubElement(inside, f"{{{GML}}}Envelope", srsName=srs)
    for name, (x, y) in {"lowerCorner": (box.min_x, box.min_y), "upperCorner": (box.max_x, box.max_y)}.items():
        ElementTree.SubElement(envelope, f"{{{GML}}}{name}").text = f"{plain_number(y)} {plain_number(x)}"
    return ElementTree.tostring(top, encoding="unicode")


def plain_number(value: float) -> str:
    """A number as text without a needless fraction or exponent: 12 and not 12.0."""
    if value != value or math.isinf(value):
        return "NaN" if value != value else "inf" if value > 0 else "-inf"
    return format(Decimal(repr(float(value))).normalize(), "f") if value else "-0" if math.copysign(1, value) < 0 else "0"


def wfs_url(base: str, layer: str, box: BBox | None = None, cql: str | None = None, limit: int = WFS_CAP) -> str:
    """GetFeature; a filter takes the box's place where one is given, and latitude comes first in a box."""
    url = f"{base.split('?')[0]}?SERVICE=WFS&VERSION=2.0.0&REQUEST=GetFeature&TYPENAMES={layer}&OUTPUTFORMAT=application/json&SRSNAME=EPSG:4326&MAXFEATURES={limit}"
    if cql is not None:
        return f"{url}&CQL_FILTER={quote(cql)}"
    return url if box is None else f"{url}&BBOX={box.min_y},{box.min_x},{box.max_y},{box.max_x},EPSG:4326"
