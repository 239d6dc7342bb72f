"""Column -> Column kernels; nothing here triggers a job or a shuffle."""
