"""Named factors over the fixtures' tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.plans.library import LIBRARY


def forecasts(s: SparkSession, d: str) -> DataFrame:
    """Three of four codes announce a range, or its lower end alone, within two weeks of the quarter's end."""
    n = F.col("code").cast("long")
    known = F.date_add("period", (1 + (n * 3 + F.quarter("period") * 11) % 14).cast("int"))
    return X.items(s, d).where(n % 4 > 0).select("code", "period", "q", known.alias("known"), F.round(F.col("net_profit") * 0.9, 0).alias("low"), F.when(n % 3 > 0, F.round(F.col("net_profit") * 1.2, 0)).alias("high"))


TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"bars": X.bars, "flow": X.flow, "flows": X.flows, "minutes": X.minutes, "actions": X.actions, "seats": X.seats, "blocks": X.blocks, "capital": X.capital, "items": X.items, "reports": X.reports, "forecasts": forecasts, "groups": X.groups}


class Inputs(Mapping):
    """The fixtures' tables under the library's names, each made when it is asked for."""

    def __init__(self, s: SparkSession, d: str):
        self.where, self.made = (s, d), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = TABLES[name](*self.where)
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


#: The factor that each FA query shows, by family.
FACTORS = {
    "01_momentum_20": "momentum_20", "01_momentum_60": "momentum_60", "01_momentum_120": "momentum_120", "01_reversal_5": "reversal_5", "01_reversal_10": "reversal_10",
    "02_volatility_20": "volatility_20", "02_volatility_60": "volatility_60",
    "03_rsi_14": "rsi_14",
    "04_amplitude_20": "amplitude_20", "04_max_return_20": "max_return_20", "04_price_position_50": "price_position_50", "04_price_position_250": "price_position_250",
    "05_downside_20": "downside_volatility_20", "05_skewness_20": "skewness_20",
    "06_size": "size", "06_total_mcap": "total_mcap", "06_turnover": "turnover",
    "07_ep": "ep_report", "07_bp": "bp_report", "07_sp": "sp_report", "07_ocfp": "ocfp_report",
    "08_ep_size_half": "ep_size_dom",
    "09_amihud_20": "amihud_20", "09_amount_cv_20": "amount_std_20", "09_turnover_std_20": "turnover_std_20", "09_avg_amount_20": "avg_amount_20",
    "10_flow_share_20": "mf_main_pct_20", "10_small_share_20": "mf_small_pct_20", "10_net_share_20": "mf_net_pct_20", "10_smart_dumb_20": "mf_smart_dumb_20",
    "11_flow_change": "mf_main_chg_20",
    "12_team_coin_20": "team_coin_20",
    "13_climb_peak_20": "climb_peak_20",
    "14_range_cv_20": "volvol_20",
    "15_amp_nonjump_20": "amp_nonjump_20", "15_jump_share_20": "jump_share_20",
    "16_boat_follow_20": "boat_follow_20",
    "17_anchor_30": "anchor_reversal_30", "17_anchor_reversal_60": "anchor_reversal_20", "17_anchor_rev_vol": "anchor_rev_vol_20",
    "18_overnight_20": "overnight_mom_20",
    "19_high_volume_20": "ev_high_vol_20", "19_low_volume_20": "ev_low_vol_20",
    "20_ep_zscore": "ep_zscore_30", "20_turn_idio_20": "turn_idio_20", "20_epd_60": "epd_60", "20_epds_60": "epds_60",
    "21_cost_bias": "chip_cost_bias", "21_chip_vwap_bias_250": "chip_vwap_bias_250",
    "22_report_change": "holder_num_chg", "22_report_change_2": "holder_num_chg_2",
    "23_event_sum_20": "event_sum_20",
    "23_dragon_net_20": "dragon_net_20", "23_block_premium_20": "block_premium_20", "24_pressure_60": "event_ahead_60", "24_lockup_pressure_60": "lockup_pressure_60",
    "25_inst_buy_20": "inst_buy_20", "25_retail_buy_20": "retail_buy_20",
    "26_margin": "margin_report", "26_roa": "roa", "26_net_margin": "net_margin", "26_asset_turnover": "asset_turnover", "26_roe": "roe", "26_debt_ratio": "debt_ratio", "26_ocf_ratio": "ocf_ratio", "26_current_ratio": "current_ratio", "26_quick_ratio": "quick_ratio",
    "27_op_margin": "op_margin", "27_goodwill_ratio": "goodwill_ratio", "27_accruals": "accruals",
    "28_revenue_growth": "revenue_growth_yoy", "28_profit_growth_yoy": "profit_growth_yoy", "28_asset_growth_yoy": "asset_growth_yoy",
    "29_np_q_yoy": "np_q_yoy", "29_rev_q_yoy": "rev_q_yoy", "29_roe_ttm": "roe_ttm", "29_roe_cut": "roe_cut", "29_roic": "roic",
    "30_gpoa": "gpoa", "30_accruals2": "accruals2", "30_ocf_to_profit": "ocf_to_profit",
    "31_ep": "ep", "31_bp": "bp",
    "32_sp_ttm": "sp_ttm", "32_cfp_ttm": "cfp_ttm",
    "33_surprise": "sue", "33_clipped_z": "amount_z_20",
    "34_acceleration": "earnings_accel",
    "35_sue_pred": "sue_pred",
    "36_sue_i": "sue_i",
    "37_sue_v2": "sue_v2", "37_sur": "sur", "37_roe_chg": "roe_chg",
    "38_sue_gpoa": "sue_gpoa", "38_gpoa_chg": "gpoa_chg",
    "39_ep_z5": "ep_z5", "39_garp": "garp", "39_ep_rank_product": "ep_momentum_product",
    "40_rv_20": "hf_rv_20", "40_rjv_20": "hf_rjv_20", "40_rsk_20": "hf_rsk_20", "40_rku_20": "hf_rku_20", "40_dsem_20": "hf_dsem_20", "40_vopen_20": "hf_vopen_20", "40_vclose_20": "hf_vclose_20", "40_vhhi_20": "hf_vhhi_20", "40_vampp_20": "hf_vampp_20", "40_rlast30_20": "hf_rlast30_20", "40_rfirst30_20": "hf_rfirst30_20", "40_hipos_20": "hf_hipos_20", "40_amihud_20": "hf_amihud_20", "40_amtrange_20": "hf_amtrange_20", "40_vwapbias_20": "hf_vwapbias_20", "40_corr_rv_20": "hf_corr_rv_20", "40_smartq_20": "hf_smartq_20", "40_topvr_20": "hf_topvr_20", "40_topvupr_20": "hf_topvupr_20", "40_rvvol_20": "hf_rvvol_20", "40_smartq_10": "hf_smartq_10",
    "41_pa_a101_040": "pa_a101_040", "41_pa_a101_044": "pa_a101_044", "41_pa_a101_088": "pa_a101_088", "41_pa_5d_min_low_ratio": "pa_5d_min_low_ratio",
    "42_formula_composite": "a191_wf_composite", "42_minute_composite": "hf_wf_composite",
    "43_kyle_lambda_24": "kyle_lambda_24", "43_cvar_20": "qz_cvar_20", "43_kpath_illiq_20": "qz_kpath_illiq_20", "43_idio_illiq_20": "qz_idio_illiq_20", "43_kyle_lambda_60": "qz_kyle_lambda_60", "43_tsim_path_20": "qz_tsim_path_20", "43_semi_illiq_dn_20": "qz_semi_illiq_dn_20", "43_semi_illiq_up_20": "qz_semi_illiq_up_20", "43_amp_downpos_20": "qz_amp_downpos_20", "43_repair_eff_20": "qz_repair_eff_20", "43_mf_sens_60": "qz_mf_sens_60",
    "45_trailing_yield": "dividend_yield",
}


def factor(query: str):
    """That FA query: its factor for all codes and dates."""
    return lambda s, d: LIBRARY.compute([FACTORS[query]], Inputs(s, d)).select("code", "date", "value")
