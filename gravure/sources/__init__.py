"""File and object scans, type detection, admission, and the rendition sink."""
