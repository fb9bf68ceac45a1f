"""Numeric kernels on numpy arrays. NaN means missing here; tables use NULL."""
