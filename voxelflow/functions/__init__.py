"""Column builders: rotations, voxel keys, covariances and closed-form eigenvalues."""
