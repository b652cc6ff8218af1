"""PDF: pages as raw images, three objects each."""

from __future__ import annotations

from pagemill.functions.page import BW1, GRAY8, RGBA32, RGB24, Page, convert


def write(pages: list[Page], size: tuple[float, float] | None = None) -> bytes:
    """A PDF 1.4 of pages in points (72 an inch; the given size, else pixels by resolution). Alpha is dropped; empty pages are left out."""
    pages = [convert(p, RGB24) if p.format == RGBA32 else p for p in pages if not p.empty]
    bodies: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for p in pages:
        n = len(bodies) + 1
        kids.append(f"{n} 0 R")
        w, h = size or (p.width * 72 / (p.dpi_x if p.dpi_x > 0 else 72), p.height * 72 / (p.dpi_y if p.dpi_y > 0 else 72))
        draw = f"q {w:g} 0 0 {h:g} 0 0 cm /Im0 Do Q".encode()
        raw = p.to_bytes()
        space = "/DeviceRGB" if p.format == RGB24 else "/DeviceGray"
        decode = " /Decode [1 0]" if p.format == BW1 else ""
        image = f"<< /Type /XObject /Subtype /Image /Width {p.width} /Height {p.height} /ColorSpace {space} /BitsPerComponent {1 if p.format == BW1 else 8}{decode} /Length {len(raw)} >>"
        bodies.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:g} {h:g}] /Contents {n + 1} 0 R /Resources << /XObject << /Im0 {n + 2} 0 R >> >> >>".encode())
        bodies.append(f"<< /Length {len(draw)} >>\nstream\n".encode() + draw + b"\nendstream")
        bodies.append(image.encode() + b"\nstream\n" + raw + b"\nendstream")
    bodies[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(bodies, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = len(out)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{at:010d} 00000 n \n".encode() for at in places)
    out += f"trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF\n".encode()
    return bytes(out)
