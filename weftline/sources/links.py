"""Text that holds many links, each a file to import."""

from __future__ import annotations

import re

from weftline.sources.files import FileSpec

_LINK = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:/[^\s]+")
#: Marks of the sentence around a link. A separator may be one of them, so it is read first.
_CLOSING = "\"'.,;:!?)]}>"


def parse_links(text: str) -> list[FileSpec]:
    """Links of any scheme Spark can read. ``?sep=`` carries the separator of its own link, up to
    the next ``&``; punctuation after a link belongs to the text around it."""
    return [_file_spec(link) for link in _LINK.findall(text)]


def _file_spec(link: str) -> FileSpec:
    path, _, query = link.partition("?")
    values = dict(field.partition("=")[::2] for field in query.split("&"))
    # a quote or bracket can only close the text around; other marks may be the separator itself
    sep = values.get("sep", "").rstrip("\"')]}>")
    return FileSpec(path if query else path.rstrip(_CLOSING), sep=sep or None)
