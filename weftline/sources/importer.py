"""Source specs: registers every dataset a spec names.

``{"Link": {"source_links": text}, "Files": [file specs], "Directory": {"path": ...},
"Stream": stream spec or list of them}``; every part is optional.
"""

from __future__ import annotations

from weftline.errors import SourceError, SpecError, WeftlineError
from weftline.sources.files import FileSpec, discover, read_file
from weftline.sources.links import parse_links
from weftline.sources.streams import read_stream
from weftline.workspace import Workspace

_PARTS = {"Link", "Files", "Directory", "Stream"}


def import_sources(
    workspace: Workspace,
    spec: dict,
    cache: bool = False,
    demand: dict[str, list[dict]] | None = None,
) -> list[str]:
    """Names of the imported datasets. ``cache`` suits interactive work on small inputs.

    ``demand`` has, per dataset, the processes that will be applied before anything else uses it:
    JSON is then parsed for the fields that are used.
    """
    demand = demand or {}
    unknown = set(spec) - _PARTS
    if unknown:
        raise SpecError(f"unknown source part(s) {sorted(unknown)}, expected {sorted(_PARTS)}")
    files = _file_specs(workspace, spec)
    names = [_import_file(workspace, file, cache, demand) for file in files]
    for stream in _streams(spec):
        names.append(_import_stream(workspace, stream, demand))
    if not names:
        raise SourceError("the source spec names nothing to import")
    return names


def _file_specs(workspace: Workspace, spec: dict) -> list[FileSpec]:
    files = parse_links((spec.get("Link") or {}).get("source_links") or "")
    files += [FileSpec(**file) for file in spec.get("Files") or []]
    directory = spec.get("Directory")
    if directory:
        found = discover(
            workspace.spark,
            directory["path"],
            tuple(directory.get("extensions", ("csv", "json"))),
        )
        files += found
    return files


def _streams(spec: dict) -> list[dict]:
    streams = spec.get("Stream") or []
    return [streams] if isinstance(streams, dict) else list(streams)


def _import_file(
    workspace: Workspace, file: FileSpec, cache: bool, demand: dict[str, list[dict]]
) -> str:
    try:
        df = read_file(workspace.spark, file, demand.get(file.dataset))
    except WeftlineError:
        raise
    except Exception as error:
        raise SourceError(f"{file.path}: {error}") from error
    workspace.add(file.dataset, df, path=file.path, cache=cache)
    return file.dataset


def _import_stream(workspace: Workspace, stream: dict, demand: dict[str, list[dict]]) -> str:
    name = stream.get("dataframe_name")
    if not name:
        raise SpecError("a stream source needs a dataframe_name")
    try:
        df = read_stream(workspace.spark, stream, demand.get(name))
    except WeftlineError:
        raise
    except Exception as error:
        raise SourceError(f"stream {name!r}: {error}") from error
    workspace.add(name, df)
    return name
