import hashlib
import os
import zlib

import numpy as np

from sigloom.llm import jpeg


def segment_bits(pairs):
    bits = "".join(f"{v:0{n}b}" for v, n in pairs if n)
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def size_of(v):
    return abs(v).bit_length()


def low_bits(v):
    n = size_of(v)
    return (v if v > 0 else v + (1 << n) - 1, n)


def grey_progressive(coef, restart=0):
    """A plain scalar encoder of one grey part with sparse coefficients: four scans, end-of-band runs, zero runs."""
    rows, cols, _ = coef.shape
    blocks = coef.reshape(-1, 64).astype(int).tolist()
    codes = {s: (k, 8) for k, s in enumerate(range(251))}  # 251 codes of eight bits
    table = bytes([0] * 7 + [251] + [0] * 8) + bytes(range(251))
    sym = lambda s: codes[s]
    out = [b"\xff\xd8", jpeg.QUANT, jpeg._segment(0xC2, bytes([8]) + (rows * 8).to_bytes(2, "big") + (cols * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])), jpeg._segment(0xC4, bytes([0]) + table + bytes([0x10]) + table)]
    if restart:
        out.append(jpeg._segment(0xDD, restart.to_bytes(2, "big")))

    def scan(band, high, low, make):
        parts = [blocks[k : k + restart] for k in range(0, len(blocks), restart)] if restart else [blocks]
        data = [segment_bits(make(p)) for p in parts]
        body = data[0] + b"".join(bytes([0xFF, 0xD0 + k % 8]) + d for k, d in enumerate(data[1:]))
        out.append(jpeg._segment(0xDA, bytes([1, 1, 0x00, *band, high << 4 | low])) + body)

    def dc(part):
        last, bits = 0, []
        for b in part:
            d = (b[0] >> 1) - last
            last = b[0] >> 1
            bits += [sym(size_of(d)), low_bits(d)]
        return bits

    def ac(part):
        bits, run = [], 0

        def flush():
            nonlocal run
            if run:
                n = run.bit_length() - 1
                bits.extend([sym(n << 4), (run - (1 << n), n)])
                run = 0

        for b in part:
            v = [int(np.sign(x) * (abs(x) >> 1)) for x in b]
            zeros, last = 0, max((k for k in range(1, 64) if v[k]), default=0)
            for k in range(1, last + 1):
                if not v[k]:
                    zeros += 1
                    continue
                flush()
                while zeros > 15:
                    bits.append(sym(0xF0))
                    zeros -= 16
                bits += [sym(zeros << 4 | size_of(v[k])), low_bits(v[k])]
                zeros = 0
            if last < 63:
                run += 1
        flush()
        return bits

    def refine(part):
        bits = []
        for b in part:
            fresh = [k for k in range(1, 64) if abs(b[k]) == 1]
            k = 1
            for f in fresh:
                while True:
                    zeros = [z for z in range(k, f) if abs(b[z]) < 2]
                    if len(zeros) <= 15:
                        break
                    stop = zeros[15]
                    bits.append(sym(0xF0))
                    bits += [(abs(b[z]) & 1, 1) for z in range(k, stop + 1) if abs(b[z]) > 1]
                    k = stop + 1
                bits += [sym(len(zeros) << 4 | 1), (int(b[f] > 0), 1)]
                bits += [(abs(b[z]) & 1, 1) for z in range(k, f) if abs(b[z]) > 1]
                k = f + 1
            if k <= 63:
                bits.append(sym(0))
                bits += [(abs(b[z]) & 1, 1) for z in range(k, 64) if abs(b[z]) > 1]
        return bits

    scan((0, 0), 0, 1, dc)
    scan((1, 63), 0, 1, ac)
    scan((0, 0), 1, 0, lambda part: [(b[0] & 1, 1) for b in part])
    scan((1, 63), 1, 0, refine)
    return b"".join(out) + b"\xff\xd9"


def test_general_scans_give_back_sparse_coefficients():
    rng = np.random.default_rng(8)
    for restart in (0, 3):
        coef = np.where(rng.random((4, 5, 64)) < 0.12, rng.integers(-60, 61, (4, 5, 64)), 0)
        coef[:, :, 0] = rng.integers(-400, 400, (4, 5))
        coef[1, 2, 1:] = 0
        coef[0, 0, 40:] = 0
        image = jpeg.coefficients(grey_progressive(coef, restart))
        assert (image["parts"][0]["coef"] == coef).all()


def test_inverse_transform_and_colour():
    coef = np.zeros((1, 1, 64), np.int16)
    coef[0, 0, 0] = 8 * 50
    coef[0, 0, 1] = 100
    image = {"height": 8, "width": 8, "quant": {0: np.ones(64, np.int32)}, "parts": [{"h": 1, "v": 1, "quant": 0, "coef": coef}]}
    x = np.arange(8)
    want = 128 + 50 + 100 * 0.5 * np.sqrt(1 / 8) * np.cos((2 * x + 1) * np.pi / 16)
    assert np.abs(jpeg.tensor(image)[0].astype(float) - want[None, :]).max() <= 0.51
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_chroma_is_upsampled():
    y, c = np.zeros((2, 2, 64), np.int16), np.zeros((1, 1, 64), np.int16)
    c[0, 0, 0] = 8 * 40
    image = {"height": 12, "width": 15, "quant": {0: np.ones(64, np.int32)}, "parts": [{"h": 2, "v": 2, "quant": 0, "coef": y}, {"h": 1, "v": 1, "quant": 0, "coef": c * 0}, {"h": 1, "v": 1, "quant": 0, "coef": c}]}
    rgb = jpeg.tensor(image)
    assert rgb.shape == (3, 12, 15) and (rgb[0] == round(128 + 1.402 * 40)).all() and (rgb[2] == 128).all()


def test_store_is_lossless():
    for data in [b"", b"a", bytes(range(256)) * 9, os.urandom(4000), b"\xff" * 700, b"\0" * 65, os.urandom(64 * 33000)]:
        n, payload = jpeg.held_payload(jpeg.coefficients(jpeg.store(data)))
        assert n == len(data) and payload == data + bytes(-len(data) % 64 if data else 64)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "héllo"), (3, "héllo"), (4, "x" * 100000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, media int")
    got = sorted(jpeg.decode_media(jpeg.encode_media(df), with_tensor=True).collect())
    for (i, t), r in zip(rows, got):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload)) and len(r.tensor) == 3 * r.height * r.width
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert got[2].media_sha256 == got[3].media_sha256 and got[2].feature == got[3].feature
    assert jpeg.decode_media(jpeg.encode_media(df.limit(0))).count() == 0


def test_unreadable_media_and_large_ids(spark):
    big, whole = 9007199254740993, jpeg.store(b"some bytes" * 50)
    rows = [(None, whole), (big, whole), (2, None), (3, whole[: len(whole) // 2]), (4, b""), (5, b"text"), (6, whole[:-2])]
    got = {r.doc_id: r for r in jpeg.decode_media(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1), with_tensor=True).collect()}
    assert set(got) == {r[0] for r in rows} and got[big].intact and got[None].n_bytes == got[big].n_bytes == 500
    assert not any(got[k].intact for k in (2, 3, 4, 5, 6)) and got[2].media_bytes is None and got[5].media_bytes == 4 and got[3].tensor is None


def test_altered_files_are_rows_that_are_not_intact():
    """Two thousand files with one to four changed, lost or added bytes: a row each, none intact with other contents."""
    rng = np.random.default_rng(21)
    whole = [jpeg.store(bytes(rng.integers(0, 256, n, np.uint8))) for n in (0, 50, 300, 900)]
    good = [jpeg._decoded(w, True) for w in whole]
    assert all(g[7] for g in good)
    intact = 0
    for k in range(2_000):
        which = k % 4
        data = bytearray(whole[which])
        for _ in range(rng.integers(1, 5)):
            at, how = int(rng.integers(len(data))), rng.integers(10)
            if how < 8:
                data[at] = int(rng.integers(256))
            elif how == 8:
                del data[at]
            else:
                data.insert(at, int(rng.integers(256)))
        got = jpeg._decoded(bytes(data), True)
        assert len(got) == len(good[0]) and got[4] == len(data)
        if got[7]:
            intact += 1
            assert got[:4] == good[which][:4] and got[6] == good[which][6] and got[10] == good[which][10]
        else:
            assert got[:4] == [None] * 4 and got[6] is None and got[8:] == [None] * 3
    assert intact < 200


def test_frames_are_no_larger_than_their_files():
    import tracemalloc

    data = bytearray(jpeg.store(b"x" * 400))
    at = data.index(b"\xff\xc2") + 5
    data[at : at + 4] = b"\xff\xff\xff\xff"
    tracemalloc.start()
    assert jpeg._decoded(bytes(data), False)[7] is False
    assert tracemalloc.get_traced_memory()[1] < 3_000_000  # tables of 65,536 places are the most
    tracemalloc.stop()
    for broken in (b"", b"\xff\xd8", b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xda\x00\x02\xff\xd9", bytes(data[:at])):
        assert jpeg._decoded(broken, False)[7] is False


def test_large_bodies_are_checked_whole():
    data = os.urandom(200_000)
    stored = bytearray(jpeg.store(data))
    assert jpeg._decoded(bytes(stored), False)[7]
    stored[len(stored) // 2] ^= 1
    assert not jpeg._decoded(bytes(stored), False)[7]
