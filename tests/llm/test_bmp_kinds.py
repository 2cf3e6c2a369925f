import numpy as np
import pytest

from kinfold.llm import media


def bmp(bits, body, palette=b"", packed=0, masks=(), width=3, height=1):
    le = lambda v, k=4: int(v).to_bytes(k, "little")
    extra = b"".join(map(le, masks)) + palette
    return b"BM" + le(0) + le(0) + le(54 + len(extra)) + le(40) + le(width) + le(height) + le(1, 2) + le(bits, 2) + le(packed) + le(0) + bytes(8) + le(len(palette) // 4) + le(0) + extra + body


RED_BLUE = bytes([0, 0, 255, 0, 255, 0, 0, 0])  # palette rows are blue, green, red, 0


def test_depths_and_masks():
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    pack = lambda v, kind: np.array(v, kind).tobytes()
    for raw, want in [
        (bmp(1, bytes([0b01000000, 0, 0, 0]), RED_BLUE), [red, blue, red]),
        (bmp(4, bytes([0x01, 0x10, 0, 0]), RED_BLUE), [red, blue, blue]),
        (bmp(8, bytes([1, 0, 1, 0]), RED_BLUE), [blue, red, blue]),
        (bmp(16, pack([0x7C00, 0x3E0, 0x1F, 0], "<u2")), [red, green, blue]),
        (bmp(16, pack([0xF800, 0x7E0, 0x1F, 0], "<u2"), packed=3, masks=(0xF800, 0x7E0, 0x1F)), [red, green, blue]),
        (bmp(32, pack([0xFF0000, 0xFF00, 0xFF], "<u4")), [red, green, blue]),
        (bmp(32, pack([0xFF, 0xFF00, 0xFF0000], "<u4"), packed=3, masks=(0xFF, 0xFF00, 0xFF0000)), [red, green, blue]),
    ]:
        assert media.decode_bmp(raw).tolist() == [want]
    for packed in (1, 2):
        with pytest.raises(ValueError):
            media.decode_bmp(bmp(8, bytes(4), RED_BLUE, packed))
