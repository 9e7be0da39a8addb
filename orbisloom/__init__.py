"""orbisloom: DataFrame operators for camera-pose, point-cloud and image-collection datasets."""
