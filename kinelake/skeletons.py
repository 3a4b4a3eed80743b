"""Skeleton models as a dimension table: keypoint id, name, parent, pre-order, partner on the other side."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Keypoint names, ids and hierarchy of each model, in pre-order; "-" is a
# keypoint that detectors do not report.
MODELS: dict[str, str] = {
    "HALPE_26": "Hip:19(RHip:12(RKnee:14(RAnkle:16(RBigToe:21(RSmallToe:23) RHeel:25))) LHip:11(LKnee:13(LAnkle:15(LBigToe:20(LSmallToe:22) LHeel:24))) Neck:18(Head:17(Nose:0) RShoulder:6(RElbow:8(RWrist:10)) LShoulder:5(LElbow:7(LWrist:9))))",
    "COCO_133_WRIST": "Hip:-(RHip:12(RKnee:14(RAnkle:16(RBigToe:20(RSmallToe:21) RHeel:22))) LHip:11(LKnee:13(LAnkle:15(LBigToe:17(LSmallToe:18) LHeel:19))) Neck:-(Nose:0(REye:2 LEye:1) RShoulder:6(RElbow:8(RWrist:10(RThumb:114 RIndex:117 RPinky:129))) LShoulder:5(LElbow:7(LWrist:9(LThumb:93 LIndex:96 LPinky:108)))))",
    "COCO_17": "Hip:-(RHip:12(RKnee:14(RAnkle:16)) LHip:11(LKnee:13(LAnkle:15)) Neck:-(Nose:0 RShoulder:6(RElbow:8(RWrist:10)) LShoulder:5(LElbow:7(LWrist:9))))",
    "HAND_21": "RWrist:0(RThumb1:1(RThumb2:2(RThumb3:3(RThumb4:4))) RIndex1:5(RIndex2:6(RIndex3:7(RIndex4:8))) RMiddle1:9(RMiddle2:10(RMiddle3:11(RMiddle4:12))) RRing1:13(RRing2:14(RRing3:15(RRing4:16))) RPinky1:17(RPinky2:18(RPinky3:19(RPinky4:20))))",
    "ANIMAL2D_17": "Hip:4(RHip:14(RKnee:15(RAnkle:16)) LHip:11(LKnee:12(LAnkle:13)) Neck:3(Nose:2(REye:1 LEye:0) RShoulder:8(RElbow:9(RWrist:10)) LShoulder:5(LElbow:6(LWrist:7))))",
    "BODY_25B": "CHip:-(RHip:12(RKnee:14(RAnkle:16(RBigToe:22(RSmallToe:23) RHeel:24))) LHip:11(LKnee:13(LAnkle:15(LBigToe:19(LSmallToe:20) LHeel:21))) Neck:17(Head:18(Nose:0) RShoulder:6(RElbow:8(RWrist:10)) LShoulder:5(LElbow:7(LWrist:9))))",
    "BODY_25": "CHip:8(RHip:9(RKnee:10(RAnkle:11(RBigToe:22(RSmallToe:23) RHeel:24))) LHip:12(LKnee:13(LAnkle:14(LBigToe:19(LSmallToe:20) LHeel:21))) Neck:1(Nose:0 RShoulder:2(RElbow:3(RWrist:4)) LShoulder:5(LElbow:6(LWrist:7))))",
    "BODY_135": "CHip:-(RHip:12(RKnee:14(RAnkle:16(RBigToe:22(RSmallToe:23) RHeel:24))) LHip:11(LKnee:13(LAnkle:15(LBigToe:19(LSmallToe:20) LHeel:21))) Neck:17(Head:18(Nose:0) RShoulder:6(RElbow:8(RWrist:10(RThumb:48 RIndex:51 RPinky:63))) LShoulder:5(LElbow:7(LWrist:9(LThumb:27 LIndex:30 LPinky:42)))))",
    "BLAZEPOSE": "Hip:-(RHip:24(RKnee:26(RAnkle:28(RHeel:30 RBigToe:32))) LHip:23(LKnee:25(LAnkle:27(LHeel:29 LBigToe:31))) Nose:0(REye:5 LEye:2) RShoulder:12(RElbow:14(RWrist:16(RPinky:18 RIndex:20 RThumb:22))) LShoulder:11(LElbow:13(LWrist:15(LPinky:17 LIndex:19 LThumb:21))))",
    "HALPE_68": "Hip:19(RHip:12(RKnee:14(RAnkle:16(RBigToe:21(RSmallToe:23) RHeel:25))) LHip:11(LKnee:13(LAnkle:15(LBigToe:20(LSmallToe:22) LHeel:24))) Neck:18(Nose:0 RShoulder:6(RElbow:8(RWrist:10(RThumb:49 RIndex:52 RPinky:64))) LShoulder:5(LElbow:7(LWrist:9(LThumb:28 LIndex:31 LPinky:43)))))",
    "HALPE_136": "Hip:19(RHip:12(RKnee:14(RAnkle:16(RBigToe:21(RSmallToe:23) RHeel:25))) LHip:11(LKnee:13(LAnkle:15(LBigToe:20(LSmallToe:22) LHeel:24))) Neck:18(Nose:0 RShoulder:6(RElbow:8(RWrist:10(RThumb:117 RIndex:120 RPinky:132))) LShoulder:5(LElbow:7(LWrist:9(LThumb:96 LIndex:99 LPinky:111)))))",
    "COCO": "CHip:-(RHip:8(RKnee:9(RAnkle:10)) LHip:11(LKnee:12(LAnkle:13)) Neck:1(Nose:0 RShoulder:2(RElbow:3(RWrist:4)) LShoulder:5(LElbow:6(LWrist:7))))",
    "MPII": "CHip:14(RHip:8(RKnee:9(RAnkle:10)) LHip:11(LKnee:12(LAnkle:13)) Neck:1(Nose:0 RShoulder:2(RElbow:3(RWrist:4)) LShoulder:5(LElbow:6(LWrist:7))))",
}

# Other names of the models.
ALIASES = {"BODY_WITH_FEET": "HALPE_26", "WHOLE_BODY_WRIST": "COCO_133_WRIST", "BODY": "COCO_17", "HAND": "HAND_21", "ANIMAL": "ANIMAL2D_17"}

Node = tuple[str, int | None, str | None]


def parse(text: str) -> list[Node]:
    """(name, id, parent) in pre-order of a hierarchy like ``a:1(b:2 c:-)``."""
    out: list[Node] = []
    stack: list[str] = []
    for token in re.findall(r"[^\s():]+:(?:\d+|-)|\(|\)", text):
        if token == "(":
            stack.append(out[-1][0])
        elif token == ")":
            stack.pop()
        else:
            name, number = token.split(":")
            out.append((name, None if number == "-" else int(number), stack[-1] if stack else None))
    return out


def from_tree(tree: dict, parent: str | None = None) -> list[Node]:
    """(name, id, parent) of a nested {name, id, children} tree, as custom models have in configuration files."""
    number = tree.get("id")
    out: list[Node] = [(tree["name"], None if number in (None, "None") else int(number), parent)]
    for child in tree.get("children", []):
        out += from_tree(child, tree["name"])
    return out


def partner(name: str) -> str:
    """The name with its side changed."""
    if name[:1] in ("R", "L"):
        return ("L" if name[0] == "R" else "R") + name[1:]
    if "right" in name:
        return name.replace("right", "left")
    return name.replace("left", "right")


def rows(model: str, nodes: list[Node]) -> list[tuple]:
    """model, kpt_id, name, parent, preorder, swap_kpt_id of the keypoints with an id.

    If a sided name has no partner, no keypoint of the model is swapped.
    """
    own = [n for n in nodes if n[1] is not None]
    by_name = {n[0]: n[1] for n in own}
    sided = [n for n in by_name if n[:1] in ("R", "L") or "right" in n or "left" in n]
    swap = all(partner(n) in by_name for n in sided)
    return [(model, number, name, parent, i, by_name[partner(name)] if swap and name in sided else number) for i, (name, number, parent) in enumerate(own)]


def nodes_of(model: str) -> list[Node]:
    return parse(MODELS[ALIASES.get(model, model)])


def skeleton_table(spark: SparkSession, custom: dict[str, list[Node]] | None = None) -> DataFrame:
    """All models, and custom ones, as a table."""
    data = [r for m in MODELS for r in rows(m, parse(MODELS[m]))]
    data += [r for m, nodes in (custom or {}).items() for r in rows(m, nodes)]
    return spark.createDataFrame(data, "model string, kpt_id int, name string, parent string, preorder int, swap_kpt_id int")
