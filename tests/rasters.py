"""Tiny rasters for the tests: PNG writing, mask <-> run conversion, brute-force morphology."""

import struct
import zlib

import numpy as np


def write_png(path, array):
    """Write a uint8 array (H, W) or RGB (H, W, 3) as PNG."""
    array = np.asarray(array, np.uint8)
    height, width = array.shape[:2]
    colour = 2 if array.ndim == 3 else 0
    raw = b"".join(b"\x00" + array[y].tobytes() for y in range(height))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def to_runs(mask, image_id):
    """(image_id, y, x_start, x_end) tuples of a boolean mask."""
    out = []
    for y, row in enumerate(np.asarray(mask, bool)):
        x = 0
        while x < len(row):
            if row[x]:
                start = x
                while x + 1 < len(row) and row[x + 1]:
                    x += 1
                out.append((image_id, y, start, x))
            x += 1
    return out


def from_runs(rows, shape):
    mask = np.zeros(shape, bool)
    for r in rows:
        mask[r["y"], r["x_start"] : r["x_end"] + 1] = True
    return mask


def dilate(mask, width, height):
    out = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        out[max(0, y - height // 2) : y + height // 2 + 1, max(0, x - width // 2) : x + width // 2 + 1] = True
    return out


def erode(mask, width, height):
    out = np.zeros_like(mask)
    for y in range(mask.shape[0]):
        for x in range(mask.shape[1]):
            out[y, x] = mask[max(0, y - height // 2) : y + height // 2 + 1, max(0, x - width // 2) : x + width // 2 + 1].all()
    return out


def clean(mask):
    for _ in range(2):
        mask = dilate(mask, 15, 15)
    for _ in range(2):
        mask = erode(mask, 15, 15)
    mask = erode(dilate(mask, 25, 5), 25, 5)
    return dilate(erode(mask, 5, 5), 5, 5)


def label(mask, diagonal=True):
    """Components by flood fill; returns an int array, 0 outside."""
    out = np.zeros(mask.shape, int)
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if diagonal else [])
    n = 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        out[y, x] = n
        while stack:
            cy, cx = stack.pop()
            for dy, dx in steps:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not out[ny, nx]:
                    out[ny, nx] = n
                    stack.append((ny, nx))
    return out


def fill(mask):
    outside = label(~mask, diagonal=False)
    edge = set(outside[0]) | set(outside[-1]) | set(outside[:, 0]) | set(outside[:, -1])
    return mask | ((outside > 0) & ~np.isin(outside, list(edge)))


def shapes():
    """Hand-made masks of one size: image name -> mask."""
    out = {}

    def new(name):
        out[name] = np.zeros((40, 64), bool)
        return out[name]

    new("bar")[10:20, 5:60] = True
    two = new("two_bars")
    two[5:12, 4:50] = True
    two[15:22, 4:50] = True
    ring = new("ring")
    ring[5:30, 10:40] = True
    ring[12:22, 18:30] = False
    nested = new("nested")
    nested[:, :] = ring
    nested[15:18, 22:26] = True
    diagonal = new("diagonal")
    diagonal[10, 10] = diagonal[11, 11] = True
    new("frame")[0:8, 30:64] = True
    new("empty")
    snake = new("snake")
    snake[2:38:4, 3:60] = True
    for i, y in enumerate(range(2, 34, 4)):
        snake[y : y + 4, 59 if i % 2 == 0 else 3] = True
    rng = np.random.default_rng(3)
    new("noise")[:, :] = rng.random((40, 64)) < 0.35
    new("speckle")[:, :] = rng.random((40, 64)) < 0.05
    return out


def outline_area(mask):
    """Area of the polygon through the outer pixels of a filled region, by windows of 2 x 2 pixels."""
    m = np.pad(mask, 1).astype(int)
    n = m[1:, 1:] + m[:-1, 1:] + m[1:, :-1] + m[:-1, :-1]
    return (n == 4).sum() + (n == 3).sum() / 2
