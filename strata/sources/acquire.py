"""Downloads of raw occurrence files.  The transport is a function, so that nothing here needs a network to be tested."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from datetime import datetime
from urllib import error, parse, request

#: Fixed values of the services: addresses, and what is asked for.
PBDB_URL = "https://paleobiodb.org/data1.2/occs/list.csv"
NEOTOMA_URL = "https://api.neotomadb.org/v2.0/data/occurrences"
PBDB_QUERY = {"show": "coords,class,paleoloc,strat,time,env,ref", "limit": "all", "vocab": "pbdb"}

#: (URL, query) to chunks of bytes
Transport = Callable[[str, dict[str, str]], Iterable[bytes]]


def http(url: str, query: dict[str, str], chunk: int = 8192) -> Iterable[bytes]:
    with request.urlopen(f"{url}?{parse.urlencode(query)}", timeout=600) as answer:
        while part := answer.read(chunk):
            yield part


def _path(folder: str, filename: str | None, stem: str, ending: str) -> str:
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, filename or f"{stem}_{datetime.now():%Y%m%d_%H%M%S}.{ending}")


def fetch_pbdb(interval: str = "Cambrian,Cretaceous", folder: str = "data/raw", filename: str | None = None, transport: Transport = http) -> str | None:
    """Streams all occurrences of an interval to a CSV file; its path, or None if the request fails."""
    query = {"interval": interval} | PBDB_QUERY
    path = _path(folder, filename, "pbdb_occurrences", "csv")
    try:
        with open(path + ".part", "wb") as out:
            for part in transport(PBDB_URL, query):
                out.write(part)
    except (error.URLError, OSError):
        if os.path.exists(path + ".part"):
            os.remove(path + ".part")
        return None
    os.replace(path + ".part", path)
    return path


def fetch_neotoma(limit: int = 10_000, folder: str = "data/raw", filename: str | None = None, transport: Transport = http) -> str | None:
    """Saves one page of occurrences as JSON; its path, or None if the request fails or the answer has no ``data``."""
    try:
        answer = json.loads(b"".join(transport(NEOTOMA_URL, {"limit": str(limit), "offset": "0"})))
    except (error.URLError, OSError, ValueError):
        return None
    if not isinstance(answer, dict) or "data" not in answer:
        return None
    path = _path(folder, filename, "neotoma_occurrences", "json")
    with open(path, "w") as out:
        json.dump(answer, out)
    return path
