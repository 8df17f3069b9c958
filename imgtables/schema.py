"""Fixed schemas and column orders of every table the package reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE_DDL = "struct<height:int,width:int,pixels:array<float>>"
IMAGE_DOUBLE_DDL = "struct<height:int,width:int,pixels:array<double>>"

DECODED_DDL = f"struct<image:{IMAGE_DDL},src_dtype:string,sha256:string,error:string>"

# Manifest column order.
MANIFEST_FIELDS = (
    "stem",
    "input_relpath",
    "target_relpath",
    "input_shape",
    "target_shape",
    "input_dtype",
    "target_dtype",
    "input_min",
    "input_max",
    "input_mean",
    "input_std",
    "target_min",
    "target_max",
    "target_mean",
    "target_std",
    "source_group",
    "texture_cluster",
    "split",
    "sha256_input",
    "sha256_target",
)
MANIFEST_NUMBERS = tuple(
    f for f in MANIFEST_FIELDS if f.rsplit("_", 1)[-1] in ("min", "max", "mean", "std")
)

# Metric column order.
METRICS = (
    "psnr_db",
    "ssim",
    "lpips_alex",
    "sobel_l1",
    "mean_intensity_bias",
    "pre_clamp_out_of_range_rate",
)
RANKED_METRICS = ("psnr_db", "ssim", "lpips_alex")
LOWER_IS_BETTER = frozenset({"lpips_alex", "sobel_l1", "mean_intensity_bias"})
METRIC_FIELDS = ("stem", "split", "texture_cluster") + METRICS + (
    "prediction_shape",
    "target_shape",
)

METRICS_DDL = (
    "struct<psnr_db:double,ssim:double,lpips_alex:double,sobel_l1:double,"
    "mean_intensity_bias:double,pre_clamp_out_of_range_rate:double,"
    "prediction_shape:string,target_shape:string>"
)

# Columns of the severity grid's rows, in order.
GRID_FIELDS = ("relative_path", "defect_group", "severity", "method") + METRICS

# Texture descriptor names and order.
TEXTURE_FIELDS = (
    "mean",
    "std",
    "q10",
    "q90",
    "entropy_32bin",
    "gradient_mean",
    "gradient_std",
    "laplacian_abs_mean",
    "fft_low_fraction",
    "fft_mid_fraction",
    "fft_high_fraction",
)

# Experiment table column order.
EXPERIMENT_FIELDS = (
    "experiment",
    "isolated_change",
    "baseline_checkpoint_sha256",
    "candidate_checkpoint_sha256",
    "manifest_sha256",
    "id_psnr_delta_db",
    "id_ssim_delta",
    "id_lpips_delta",
    "ood_psnr_delta_db",
    "ood_ssim_delta",
    "ood_lpips_delta",
    "ood_metric_wins",
    "id_psnr_floor_db",
    "id_ssim_floor",
    "decision",
    "reason",
)

# The three degradation levels of the severity grid.
SEVERITIES = {
    "downsample_only": {
        "gaussian_noise_std": 0.0,
        "speckle_std": 0.0,
        "bias_low": 0.0,
        "bias_high": 0.0,
    },
    "profile_low": {
        "gaussian_noise_std": 0.032383059530957825,
        "speckle_std": 0.04536565160023246,
        "bias_low": -0.000876969425291918,
        "bias_high": 0.0008910448643320024,
    },
    "profile_high": {
        "gaussian_noise_std": 0.08066570470161874,
        "speckle_std": 0.06322856237103856,
        "bias_low": -0.000876969425291918,
        "bias_high": 0.0008910448643320024,
    },
}

_RANGE = "struct<low:double,high:double>"
PROFILE_DDL = (
    f"struct<schema_version:int,fit_split:string,fit_pair_count:bigint,manifest_sha256:string,"
    f"blur_sigma:{_RANGE},gaussian_noise_std:{_RANGE},speckle_std:{_RANGE},"
    f"additive_bias:{_RANGE},downsample_modes:array<string>,operation_order:string,"
    f"output_clipped:boolean,public_test_used:boolean>"
)

HISTORY_DDL = (
    "run string, step bigint, epoch bigint, train_loss double, best_train_loss double, "
    "raw_val_psnr_db double, ema_val_psnr_db double, selected_val_psnr_db double, "
    "selected_weights string, supervised_loss double, distillation_loss double, lr double"
)


def text_schema(fields) -> T.StructType:
    """A CSV schema in which every column is text, as manifests are stored."""
    return T.StructType([T.StructField(f, T.StringType(), True) for f in fields])
