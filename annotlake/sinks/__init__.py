"""Writers and the tables they write: COCO, YOLO, CSV."""
