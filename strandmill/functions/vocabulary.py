"""The detection vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The COCO class names in the order of their ids.
CLASSES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee",
    "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed",
    "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard", "cell phone", "microwave", "oven",
    "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)

#: Classes taken into account by traffic analysis, and those that weigh more as rare.
TRAFFIC_CLASSES = (0, 1, 2, 3, 5, 7)
RARE_CLASSES = ("person", "bicycle", "motorcycle", "bus", "truck")


def class_name(class_id: Column) -> Column:
    """The name of a class id; '' out of range."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    return F.when(class_id.between(0, len(CLASSES) - 1), F.get(names, class_id)).otherwise(F.lit(""))
