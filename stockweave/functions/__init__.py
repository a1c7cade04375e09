"""Column-level helpers and distributed scans."""
