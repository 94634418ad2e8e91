"""Headers and small sidecar files of recordings and sortings, read on the driver."""

from __future__ import annotations

import ast
import json
import os
import re
import struct
from dataclasses import dataclass

import numpy as np

#: Codes of the MDA format and numpy types (fixed values).
MDA_TYPES = {-1: "<c8", -2: "u1", -3: "<f4", -4: "<i2", -5: "<i4", -6: "<u2", -7: "<f8", -8: "<u4"}
LABELS = ("noise", "mua", "good", "unsorted")


def detect(path: str) -> str:
    """The format of a path by its shape: nwb, rez, phy, nwb_zarr, analyzer; ValueError for what is none."""
    name = os.path.basename(path.rstrip("/"))
    if os.path.isfile(path):
        if name.lower().endswith(".nwb"):
            return "nwb"
        if name in ("rez.mat", "rez2.mat"):
            return "rez"
        raise ValueError(f"{path}: a file of no known format")
    has = lambda *names: all(os.path.exists(os.path.join(path, n)) for n in names)
    if has("spike_times.npy", "spike_clusters.npy"):
        return "phy"
    if name.endswith(".nwb.zarr"):
        return "nwb_zarr"
    if has(".zgroup") or has("zarr.json"):
        raise ValueError(f"{path}: save the analyzer as binary_folder first")
    if (has("recording.json") or has("binary.json")) and os.path.isdir(os.path.join(path, "sorting")):
        return "analyzer"
    raise ValueError(f"{path}: a folder of no known format")


def params(text: str) -> dict:
    """Scalar assignments of a params.py; lines that are none are passed over."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*([A-Za-z_]\w*)\s*=\s*(.+?)\s*(?:#.*)?$", line)
        if m:
            try:
                out[m[1]] = ast.literal_eval(m[2])
            except (ValueError, SyntaxError):
                out[m[1]] = m[2].strip("rRbB").strip("'\"")
    return out


@dataclass(frozen=True)
class Npy:
    shape: tuple[int, ...]
    dtype: np.dtype
    fortran: bool
    offset: int


def npy_header(path: str) -> Npy:
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
        return Npy(shape, dtype, fortran, f.tell())


def whole_numbers(path: str, most: int = 2**32 - 1) -> np.ndarray:
    """A 1-D array of whole numbers as int64; ValueError for other kinds and for what is out of bounds."""
    x = np.load(path)
    if x.dtype.kind not in "iu":
        raise ValueError(f"{path}: {x.dtype} is no whole number")
    x = x.reshape(-1)
    if len(x) and (int(x.min()) < 0 or int(x.max()) > most):
        raise ValueError(f"{path}: numbers beyond 0 to {most}")
    return x.astype(np.int64)


def save_npy(path: str, data: np.ndarray) -> None:
    """Writes beside the file, then takes its place, so that a reader never sees half a file."""
    with open(f"{path}.tmp", "wb") as f:
        np.save(f, data)
    os.replace(f"{path}.tmp", path)


@dataclass(frozen=True)
class Mda:
    dtype: np.dtype
    shape: tuple[int, ...]
    offset: int


def mda_header(path: str) -> Mda:
    """Code, bytes an entry, number of dimensions (negative: 64-bit sizes), sizes."""
    with open(path, "rb") as f:
        code, _, dims = struct.unpack("<iii", f.read(12))
        wide, dims = dims < 0, abs(dims)
        if code not in MDA_TYPES or not 0 < dims <= 16:
            raise ValueError(f"{path}: type {code}, {dims} dimensions")
        shape = struct.unpack(f"<{dims}{'q' if wide else 'i'}", f.read(dims * (8 if wide else 4)))
        if min(shape) < 0:
            raise ValueError(f"{path}: shape {shape}")
        return Mda(np.dtype(MDA_TYPES[code]), shape, f.tell())


def spikeglx(text: str) -> dict:
    """sample_rate, n_channels and all entries of a SpikeGLX .meta; only int16 data are taken."""
    raw = dict(re.split(r"\s*=\s*", line.strip(), maxsplit=1) for line in text.splitlines() if "=" in line and line.strip()[0] not in ";#")
    rate = next((float(raw[k]) for k in ("imSampRate", "niSampRate", "sRateHz") if k in raw), None)
    channels = next((int(raw[k]) for k in ("nSavedChans", "nChans") if k in raw), None)
    if rate is None or channels is None:
        raise ValueError("no sample rate or number of channels")
    if raw.get("dataType", "I").strip().lower() not in ("i", "int16"):
        raise ValueError(f"data type {raw['dataType']}")
    return {"sample_rate": rate, "n_channels": channels, "raw": raw}


def open_ephys(text: str) -> list[dict]:
    """folder, sample_rate, n_channels of the continuous streams of a structure.oebin."""
    return [{"folder": s.get("folder_name", "").rstrip("/"), "sample_rate": float(s["sample_rate"]), "n_channels": int(s["num_channels"])} for s in json.loads(text).get("continuous", [])]


def probe(text: str) -> list[dict]:
    """channel, x, y, shank of a probeinterface JSON, by device channel where it has them."""
    out, base = [], 0
    for p in json.loads(text)["probes"]:
        places = p["contact_positions"]
        channels = p.get("device_channel_indices") or range(base, base + len(places))
        shanks = p.get("shank_ids") or [""] * len(places)
        names = {s: i for i, s in enumerate(dict.fromkeys(shanks))}
        out += [{"channel": int(c), "x": float(xy[0]), "y": float(xy[1]), "shank": names[s]} for c, xy, s in zip(channels, places, shanks, strict=True) if int(c) >= 0]
        base += len(places)
    return out


ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}


def escape_note(text: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in text)


def unescape_note(text: str) -> str:
    """The inverse; an unknown escape stands for its character, a last lone backslash for itself."""
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n", "r": "\r"}.get(m[1], m[1]), text, flags=re.S)


def label(text: str) -> str:
    x = text.strip().lower()
    return x if x in LABELS else "unsorted"


def table_of(path: str, columns: int) -> list[list[str]]:
    """Rows of a tab-separated file with a head, each with so many columns; none where there is no file."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\r\n").split("\t", columns - 1) for line in f][1:]
    return [r + [""] * (columns - len(r)) for r in rows if r and r[0].strip().isdigit()]


def group_labels(path: str) -> dict[int, str]:
    return {int(r[0]): label(r[1]) for r in table_of(path, 2)}


def tags(path: str) -> dict[int, list[str]]:
    return {int(r[0]): [t.strip() for t in r[1].split(",") if t.strip()] for r in table_of(path, 2)}


def annotations(path: str) -> dict[int, dict]:
    """origin, parents, note by cluster."""
    return {int(r[0]): {"origin": unescape_note(r[1].strip()), "parents": [int(p) for p in r[2].split(",") if p.strip().isdigit()], "note": unescape_note(r[3])} for r in table_of(path, 4)}


def metric(path: str) -> dict[int, float] | None:
    """A per-cluster metric; None if any entry is no number."""
    out = {}
    for key, text in table_of(path, 2):
        try:
            out[int(key)] = float(text) if text.strip() else float("nan")
        except ValueError:
            return None
    return out


def curation(text: str) -> tuple[list[tuple[str, str | None, list[str]]], list[list[str]]]:
    """Labels (unit, label, tags) and merge groups of a curation document; ValueError for histories, splits and removals."""
    doc = json.loads(text)
    if isinstance(doc, list):
        raise ValueError("a history of edits can't be replayed from JSON")
    if any(doc.get(k) for k in ("splits", "removed", "removed_units")):
        raise ValueError("splits and removed units can't be imported")
    labels = []
    for e in doc.get("manual_labels") or []:
        sets = e.get("labels", e)
        quality = sets.get("quality") or []
        labels.append((str(e["unit_id"]), label(quality[0]) if quality else None, [str(t) for t in sets.get("tags") or []]))
    groups = [m["unit_ids"] for m in doc.get("merges") or []] if doc.get("merges") is not None else doc.get("merge_unit_groups") or []
    if any(not isinstance(g, list) or len(g) < 2 for g in groups):
        raise ValueError("a merge group needs two units")
    return labels, [[str(u) for u in g] for g in groups]
