"""Small dense linear algebra in numpy: rotations, preintegration, filters and bundle adjustment."""
