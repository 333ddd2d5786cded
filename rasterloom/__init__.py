"""Image enhancement and super-resolution as Spark plans over relations of pixels."""
