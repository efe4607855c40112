"""Readers: image folders, stored masks, COCO, YOLO, project configuration."""
