"""Column builders: box geometry, quaternions, spherical harmonics."""
