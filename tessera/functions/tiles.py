"""Vector tiles as bytes: layers of polygons whose rings are streams of commands with zig-zag deltas, and back.

Rings keep their order and winding: an outer ring runs clockwise on the screen (y goes down), its holes
the other way. Values of properties are texts, whole numbers, numbers and booleans.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Fixed values of the format: commands, the kind of geometry, the wire types, and the numbers of fields.
MOVE, LINE, CLOSE, POLYGON = 1, 2, 7, 3
VARINT, EIGHT, BYTES, FOUR = 0, 1, 2, 5
LAYER, NAME, FEATURE, KEY, VALUE, EXTENT, VERSION = 3, 1, 2, 3, 4, 5, 15
ID, TAGS, KIND, GEOMETRY = 1, 2, 3, 4
TEXT, DOUBLE, INT, BOOLEAN = 1, 3, 6, 7

Ring = list[tuple[int, int]]


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def unzigzag(n: int) -> int:
    return n >> 1 if n % 2 == 0 else -((n + 1) >> 1)


def commands(rings: list[Ring]) -> list[int]:
    """The command stream of a polygon's rings; each point is told by its difference to the one before, rings go on from each other."""
    out, x, y = [], 0, 0
    for ring in rings:
        deltas = []
        for px, py in ring:
            deltas += [zigzag(px - x), zigzag(py - y)]
            x, y = px, py
        out += [1 << 3 | MOVE, *deltas[:2], len(ring) - 1 << 3 | LINE, *deltas[2:], 1 << 3 | CLOSE]
    return out


def rings_of(stream: list[int]) -> list[Ring]:
    """The rings of a command stream; a ValueError names a command that no polygon has."""
    rings: list[Ring] = []
    at, x, y = 0, 0, 0
    while at < len(stream):
        command, count = stream[at] & 7, stream[at] >> 3
        at += 1
        if command == CLOSE:
            continue
        if command not in (MOVE, LINE) or command == LINE and not rings:
            raise ValueError(f"command {command} in a polygon")
        for _ in range(count):
            x, y = x + unzigzag(stream[at]), y + unzigzag(stream[at + 1])
            at += 2
            if command == MOVE:
                rings.append([])
            rings[-1].append((x, y))
    return rings


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _varints(data: bytes) -> Iterator[int]:
    n = shift = 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            yield n
            n = shift = 0
    if shift:
        raise ValueError("a number breaks off")


def _field(number: int, wire: int, value: bytes | int) -> bytes:
    head = varint(number << 3 | wire)
    return head + (varint(value) if wire == VARINT else value if wire == EIGHT else varint(len(value)) + value)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = number()
        if key & 7 == VARINT:
            yield key >> 3, number()
            continue
        size = {EIGHT: 8, FOUR: 4}.get(key & 7) or number()
        if at + size > len(data):
            raise ValueError("a field breaks off")
        yield key >> 3, data[at : at + size]
        at += size


def _value(v: str | int | float | bool) -> bytes:
    if isinstance(v, bool):
        return _field(BOOLEAN, VARINT, int(v))
    if isinstance(v, int):
        return _field(INT, VARINT, zigzag(v))
    return _field(DOUBLE, EIGHT, struct.pack("<d", v)) if isinstance(v, float) else _field(TEXT, BYTES, v.encode())


def _value_of(data: bytes) -> str | int | float | bool:
    number, v = next(_fields(data))
    return {TEXT: lambda: v.decode(), DOUBLE: lambda: struct.unpack("<d", v)[0], INT: lambda: unzigzag(v), BOOLEAN: lambda: bool(v)}[number]()


def encode(layer: str, features: list[tuple[int, list[Ring], dict]], extent: int = 4096) -> bytes:
    """A tile of one layer from (id, rings, properties); without features it is empty, as a tile of nothing is."""
    if not features:
        return b""
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    body = _field(NAME, BYTES, layer.encode())
    for id_, rings, properties in features:
        tags = [n for k, v in properties.items() if v is not None for n in (keys.setdefault(k, len(keys)), values.setdefault((type(v), v), len(values)))]
        own = _field(ID, VARINT, id_) + (_field(TAGS, BYTES, b"".join(map(varint, tags))) if tags else b"")
        own += _field(KIND, VARINT, POLYGON) + _field(GEOMETRY, BYTES, b"".join(map(varint, commands(rings))))
        body += _field(FEATURE, BYTES, own)
    body += b"".join(_field(KEY, BYTES, k.encode()) for k in keys) + b"".join(_field(VALUE, BYTES, _value(v)) for _, v in values)
    return _field(LAYER, BYTES, body + _field(EXTENT, VARINT, extent) + _field(VERSION, VARINT, 2))


def decode(tile: bytes) -> dict[str, dict]:
    """The layers of a tile by name: their extent and features (id, rings, properties)."""
    layers = {}
    for number, data in _fields(tile):
        if number != LAYER:
            continue
        name, extent, keys, values, features = "", 4096, [], [], []
        for n, v in _fields(data):
            if n == NAME:
                name = v.decode()
            elif n == EXTENT:
                extent = v
            elif n == KEY:
                keys.append(v.decode())
            elif n == VALUE:
                values.append(_value_of(v))
            elif n == FEATURE:
                own = dict(_fields(v))
                features.append((own.get(ID, 0), list(_varints(own.get(TAGS, b""))), rings_of(list(_varints(own.get(GEOMETRY, b""))))))
        layers[name] = {"extent": extent, "features": [(i, rings, {keys[k]: values[v] for k, v in zip(tags[0::2], tags[1::2], strict=True)}) for i, tags, rings in features]}
    return layers
