"""Image kernels in numpy, called for whole images inside one mapInPandas."""
