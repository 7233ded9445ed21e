"""Declared schemas of the input and result tables; reads fail on mismatch."""

from __future__ import annotations

SAMPLES = (
    "domain string, backbone string, seed int, split string, sample_id bigint, group_id string, "
    "label int, logits array<double>, feats array<double>"
)
HEADS = "domain string, backbone string, seed int, class int, weight array<double>, bias double"
SCORES = "domain string, backbone string, seed int, split string, sample_id bigint, method string, score double"
SCORE_COMPARISON = (
    "Method string, AUROC double, FPR95 double, Threshold double, AUROC_CI_low double, "
    "AUROC_CI_high double, FPR95_CI_low double, FPR95_CI_high double"
)
GROUP_METADATA = "patient string, slide int, center int, tumor int, split int"
ONE_HOT_LABELS = "image string, MEL double, NV double, BCC double, AKIEC double, BKL double, DF double, VASC double"
CODED_LABELS = "img_id string, diagnostic string"
BINARY_LABELS = "image string, binary_label int"
EPOCH_LOG = "backbone string, seed int, epoch int, id_val_acc double, msp_auroc double"
ANNOTATIONS = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<int>>>"
)
TRAIN_META = "best_id_val_acc double"
GROUP_SPLIT = "patient string, slides string, n_patches int, tumor_frac double, half string"
ACTIVATIONS = "split string, layer string, channel int, sum double, n double"
READER_CASES = (
    "image_path string, gt_label string, id_ood_flag string, ai_pred string, ai_prob_malignant double, "
    "ai_prob_pred double, ai_correct int, maha_score double, reliability_flag string, "
    "behavior_group string, danger_score double"
)
RISK_BY_MODEL = (
    "domain string, model string, protocol string, method string, ood_auroc double, aurc double, "
    "coverage_at_risk10 double, coverage_at_risk15 double, full_risk double, n int"
)
