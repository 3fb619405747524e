"""Fixed values and default parameters.

Everything in the FIXED VALUES block must equal the screening application's
definitions for results to match (header names, column names, thresholds,
rule tables, colour ramps, label texts). They are stated plainly, in the
order the application uses them. Tunable parameters live in dataclasses below.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the screening application)
# ---------------------------------------------------------------------------

# Source header -> snake_case column, in sheet order.
HEADER_MAP = {
    "Kecamatan Domisili": "kecamatan",
    "Desa Kelurahan Domisili": "desa",
    "NIK": "nik",
    "Nama Lengkap": "nama",
    "Jenis Kelamin": "jenis_kelamin",
    "Berat Badan Kg": "berat_badan",
    "Pengukuran Tinggi Badan cm": "tinggi_badan",
    "Riwayat Tekanan Darah": "riwayat_hipertensi",
    "Tekanan Darah Sistolik": "sistolik",
    "Tekanan Darah Diastolik": "diastolik",
    "Gula Darah Sewaktu mg Atau dL": "gds_1",
    "Gula Darah Sewaktu Ke 2 GDS Ke 2 mg Atau dL": "gds_2",
    "Gula Darah Puasa mg Atau dL": "gdp",
    "Gula Darah 2 Jam PP GD2PP mg Atau dL": "gd2pp",
    "Interpretasi SKILAS Penurunan Kognitif": "gangguan_kognitif",
    "Interpretasi SKILAS Malnutrisi": "malnutrisi",
    "SKILAS Intepretasi Gejala Depresi": "depresi",
    "Nilai Kolesterol Total": "kolesterol",
    "Tanggal Lahir": "tanggal_lahir",
}
RAW_COLUMNS = list(HEADER_MAP.values())

STRING_COLUMNS = ["kecamatan", "desa", "nama", "nik"]
NUMERIC_TEXT_COLUMNS = [
    "berat_badan", "tinggi_badan", "sistolik", "diastolik",
    "gds_1", "gds_2", "gdp", "gd2pp", "kolesterol",
]
GLUCOSE_COLUMNS = ["gds_1", "gds_2", "gdp", "gd2pp"]

# Null tokens produced by text conversion of missing cells (case-sensitive).
NULL_TOKENS = ["nan", "None", ""]

# Characters removed at both ends by the text strip (Python str.strip whitespace).
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The 14 clustering features, in model order.
FEATURES = [
    "umur", "jenis_kelamin", "imt", "sistolik", "diastolik",
    "gds_1", "gds_2", "gdp", "gd2pp", "kolesterol",
    "riwayat_hipertensi", "gangguan_kognitif", "malnutrisi", "depresi",
]
BINARY_COLUMNS = [
    "jenis_kelamin", "riwayat_hipertensi", "gangguan_kognitif", "malnutrisi", "depresi",
]
# Columns forced numeric in the final validation.
VALIDATE_NUMERIC = [
    "umur", "imt", "berat_badan", "tinggi_badan", "sistolik", "diastolik",
    "gds_1", "gds_2", "gdp", "gd2pp", "kolesterol",
]
# Inclusive valid ranges.
RANGE_RULES = {
    "umur": (40, 120),
    "imt": (10, 60),
    "sistolik": (60, 300),
    "diastolik": (30, 200),
    "gds_1": (20, 800),
    "gds_2": (20, 800),
    "gdp": (20, 800),
    "gd2pp": (20, 800),
    "kolesterol": (50, 600),
}
AGE_RANGE = (40, 120)
BMI_RANGE = (10, 60)
COL_MISSING_THRESHOLD = 0.70
ROW_MISSING_THRESHOLD = 0.50

# Birth date texts that are understood, tried in this order.
DATE_FORMATS = ("iso", "dd/MM/yyyy", "dd-MM-yyyy")

# Sex / yes-no / boolean code tables.
SEX_TEXT = {"Laki-laki": 1, "Perempuan": 0}
HYPERTENSION_TEXT = {"Ya": 1, "Tidak": 0}
SEX_CODE_MALE = ["L", "LAKI-LAKI", "LAKI", "1"]
SEX_CODE_FEMALE = ["P", "PEREMPUAN", "PR", "0"]
BOOL_VISIT = ["V", "BARU", "LAMA"]
BOOL_TRUE = ["Y", "YA", "1", "TRUE", "YES", "*"]
BOOL_FALSE = ["T", "TIDAK", "0", "FALSE", "NO"]

# Blood pressure split bounds (P15) and text-BMI bounds.
BP_SYS_RANGE = (50, 300)
BP_DIA_RANGE = (30, 200)

# Individual risk (P19): reasons in order.
INDIVIDUAL_REASONS = [
    "Lansia (umur >= 60)",
    "Underweight/Malnutrisi (IMT < 18.5)",
    "Overweight/Obesitas (IMT >= 27.0)",
    "Hipertensi (TD >= 140/90)",
    "Hiperglikemia/DM (GD >= 140)",
    "Hiperkolesterolemia (Kolesterol >= 200)",
]

# Composite cluster risk score (K15): feature -> ordered (threshold rule, points).
# A rule is (">=", t) or ("<", t); a step fires when any of its rules holds; first step wins.
RISK_SCORE_RULES = {
    "umur": [([(">=", 75)], 2.0), ([(">=", 70)], 1.5), ([(">=", 65)], 1.0), ([(">=", 60)], 0.5)],
    "imt": [([(">=", 30), ("<", 18.5)], 2.0), ([(">=", 27), ("<", 20)], 1.0), ([(">=", 25)], 0.5)],
    "sistolik": [([(">=", 160)], 3.0), ([(">=", 140)], 2.0), ([(">=", 130)], 1.0), ([(">=", 120)], 0.5)],
    "diastolik": [([(">=", 100)], 2.0), ([(">=", 90)], 1.5), ([(">=", 80)], 0.5)],
    "gds_1": [([(">=", 200)], 3.0), ([(">=", 140)], 2.0), ([(">=", 126)], 1.0), ([(">=", 100)], 0.5)],
    "kolesterol": [([(">=", 240)], 2.0), ([(">=", 200)], 1.0), ([(">=", 180)], 0.3)],
}
RISK_KEY_FEATURES = ["umur", "imt", "sistolik", "diastolik", "kolesterol", "gds_1"]
RANK_LABELS = ("RELATIF SEHAT", "RISIKO SEDANG", "RISIKO TINGGI")
RANK_TO_LEVEL = {"RELATIF SEHAT": "Sehat", "RISIKO SEDANG": "Sedang", "RISIKO TINGGI": "Tinggi"}
DEFAULT_LEVEL = "Sedang"

# Choropleth ramps (P21): filter -> (upper-inclusive cut, colour) ..., final colour.
COLOUR_RAMPS = {
    "sehat": ([20, 40, 60, 80], ["#ecfdf5", "#d1fae5", "#6ee7b7", "#34d399", "#059669"]),
    "sedang": ([20, 40, 60, 80], ["#fff7ed", "#ffedd5", "#fdba74", "#fb923c", "#ea580c"]),
    "tinggi": ([10, 25, 45, 65], ["#fef2f2", "#fee2e2", "#fca5a5", "#f87171", "#dc2626"]),
    "all": ([15, 35, 55, 75], ["#10b981", "#84cc16", "#eab308", "#f97316", "#ef4444"]),
}
NO_DATA_COLOUR = "#e2e8f0"

# Indonesian month names in calendar order.
MONTHS = [
    "januari", "februari", "maret", "april", "mei", "juni",
    "juli", "agustus", "september", "oktober", "november", "desember",
]

# Metric quality bands (K20): (cut, label) from best to worst, then the fallback label.
BAND_LABELS = ("Sangat Baik", "Baik", "Cukup", "Kurang")
SILHOUETTE_CUTS = (0.7, 0.5, 0.25)      # higher is better
DBI_CUTS = (0.5, 1.0, 2.0)              # lower is better
CH_CUTS = (500, 200, 100)               # higher is better

# Cluster interpretation tags (K17): feature -> ordered (threshold, tag), fallback tag.
INTERPRET_TAGS = {
    "umur": ([(70, "tua (≥70)"), (60, "paruh baya (60-69)")], "pra-lansia (45-59)"),
    "imt": ([(30, "obesitas"), (25, "overweight"), (18.5, "normal")], "underweight"),
    "sistolik": ([(180, "hipertensi berat"), (140, "hipertensi"), (120, "pra-hipertensi")], "normal"),
    "kolesterol": ([(200, "tinggi (≥200)"), (180, "batas tinggi")], "normal"),
    "gds_1": ([(200, "diabetes (≥200)"), (140, "pra-diabetes (≥140)"), (100, "batas (≥100)")], "normal"),
}
RISK_NOTES = {
    "RISIKO TINGGI": "(skor risiko tertinggi di antara semua cluster)",
    "RISIKO SEDANG": "(skor risiko menengah di antara semua cluster)",
    "RELATIF SEHAT": "(skor risiko terendah di antara semua cluster)",
}

# The interpretation's lines, in order: feature -> (text before the mean, decimals, text after it); a tag follows.
INTERPRET_LINES = {
    "umur": ("  • Rata-rata umur  : ", 1, " th"),
    "imt": ("  • Rata-rata IMT   : ", 1, ""),
    "sistolik": ("  • Rata-rata TD    : ", 0, " mmHg"),
    "kolesterol": ("  • Kolesterol      : ", 0, " mg/dL"),
    "gds_1": ("  • GDS 1           : ", 0, " mg/dL"),
}
INTERPRET_CONCLUSION = "  → Kesimpulan      : "

# Report risk conclusion (K19) labels.
REPORT_LEVELS = ("Tinggi", "Sedang", "Rendah (Sehat)")

# Report columns shown first (S18) and GIS export projection (S17), in order.
REPORT_FIRST_COLUMNS = [
    "nama", "nik", "desa", "umur", "jenis_kelamin", "imt", "sistolik", "diastolik",
    "cluster", "cluster_label",
]
SEX_LABELS = {1: "Laki-laki", 0: "Perempuan"}
GIS_EXPORT_COLUMNS = [
    "nama", "nik", "kecamatan", "desa", "umur", "jenis_kelamin",
    "cluster", "cluster_label", "imt", "sistolik", "diastolik",
    "kolesterol", "gds_1", "gds_2", "gdp", "gd2pp",
    "riwayat_hipertensi", "gangguan_kognitif", "malnutrisi", "depresi",
]


# ---------------------------------------------------------------------------
# Parameters
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class CleanParams:
    district: str = "MAESAN"
    as_of_year: int = 2025
    col_missing_threshold: float = COL_MISSING_THRESHOLD
    date_formats: tuple = DATE_FORMATS
    row_missing_threshold: float = ROW_MISSING_THRESHOLD
    features: tuple = tuple(FEATURES)


@dataclass(frozen=True)
class LloydParams:
    k: int = 3
    iterations: int = 5
    distance_digits: int = 4      # distances rounded before argmin (tie -> lowest id)
    centroid_digits: int = 9      # centroids rounded after averaging (order-free sums)


@dataclass(frozen=True)
class KMeansParams:
    k: int = 3
    seed: int = 42
    restarts: int = 10
    max_k: int = 10
    max_iter: int = 300
    tol: float = 1e-4


# ---------------------------------------------------------------------------
# FIXED VALUES: quality bands (K20), best first: colour and description of the evaluation page,
# wording of the report; and what the page says of each metric.
# ---------------------------------------------------------------------------
BAND_COLOURS = ("success", "success", "warning", "danger")
BAND_DESCRIPTIONS = {
    "silhouette": ("Cluster sangat terpisah dengan jelas. Struktur clustering sangat kuat.",
                   "Cluster terpisah dengan baik. Struktur clustering cukup kuat.",
                   "Cluster agak tumpang tindih. Struktur clustering masih bisa diterima.",
                   "Cluster saling tumpang tindih. Perlu evaluasi ulang jumlah cluster."),
    "dbi": ("Cluster sangat kompak dan terpisah jauh satu sama lain.",
            "Cluster cukup kompak dan terpisah dengan baik.",
            "Cluster masih bisa dibedakan namun ada area tumpang tindih.",
            "Cluster terlalu menyebar atau terlalu berdekatan."),
    "ch": ("Cluster sangat dense dan terpisah jauh satu sama lain.",
           "Cluster cukup dense dan terpisah dengan baik.",
           "Cluster masih bisa dibedakan namun densitas kurang optimal.",
           "Cluster kurang dense atau kurang terpisah. Perlu evaluasi ulang."),
}
REPORT_BANDS = {
    "silhouette": ("Sangat Baik (Struktur Kuat)", "Baik (Struktur Cukup)", "Cukup (Cluster Tumpang Tindih)", "Kurang Baik (Struktur Lemah)"),
    "dbi": ("Sangat Baik (Sangat Kompak)", "Baik (Kompak)", "Cukup Baik", "Kurang Baik (Menyebar)"),
}
# metric: (explanation, formula, strengths, weaknesses)
METRIC_TEXTS = {
    "silhouette": ("Silhouette Score mengukur seberapa mirip sebuah data dengan cluster-nya sendiri "
                   "dibandingkan dengan cluster tetangga terdekat. Nilai berkisar dari -1 hingga 1. "
                   "Semakin mendekati 1, semakin baik pemisahan antar cluster.",
                   "S(i) = (b(i) - a(i)) / max(a(i), b(i))",
                   ("Mudah diinterpretasikan (range -1 hingga 1)", "Tidak memerlukan ground truth", "Memperhitungkan kohesi dan separasi cluster"),
                   ("Kurang efektif untuk cluster dengan bentuk tidak konveks", "Sensitif terhadap outlier", "Komputasi bisa lambat untuk dataset besar")),
    "dbi": ("Davies-Bouldin Index mengukur rata-rata 'similarity' antar cluster. "
            "Semakin kecil nilainya (mendekati 0), semakin baik pemisahan cluster. "
            "DBI memperhitungkan jarak intra-cluster dan jarak antar-centroid.",
            "DBI = (1/K) × Σ max(j≠i) [(σᵢ + σⱼ) / d(cᵢ, cⱼ)]",
            ("Nilai selalu ≥ 0, mudah dipahami (semakin kecil semakin baik)", "Memperhitungkan dispersi cluster dan jarak antar centroid",
             "Komputasi relatif efisien"),
            ("Cenderung bias terhadap cluster berbentuk konveks", "Menggunakan centroid sebagai representasi, tidak cocok untuk bentuk arbitrer",
             "Sensitif terhadap noise/outlier")),
    "ch": ("Calinski-Harabasz Score (Variance Ratio Criterion) mengukur rasio antara "
           "dispersi antar-cluster dan dispersi intra-cluster. Semakin tinggi nilainya, "
           "semakin baik cluster terpisah dan semakin dense anggota dalam cluster.",
           "CH = [tr(Bₖ)/(K-1)] / [tr(Wₖ)/(n-K)]",
           ("Komputasi sangat cepat", "Nilai semakin tinggi semakin baik, intuitif", "Bagus untuk cluster berbentuk konveks dan dense"),
           ("Cenderung bias terhadap cluster konveks", "Tidak memiliki range tetap, sulit untuk threshold absolut",
            "Kurang efektif untuk cluster dengan kepadatan berbeda")),
}


# ---------------------------------------------------------------------------
# FIXED VALUES: cluster recommendations (K18), in the application's order.
# ---------------------------------------------------------------------------
LEVEL_META = {
    "RISIKO TINGGI": ("Risiko Tinggi", "danger",
                      "Cluster ini memiliki kombinasi indikator kesehatan paling buruk dibanding "
                      "cluster lain: IMT overweight, tekanan darah paling tinggi, dan gula darah "
                      "paling tinggi. Memerlukan intervensi medis aktif, kunjungan rumah (home care), "
                      "dan pemantauan ketat oleh tenaga kesehatan."),
    "RISIKO SEDANG": ("Risiko Sedang", "warning",
                      "Cluster dengan tingkat risiko menengah. Beberapa indikator (tekanan darah, "
                      "IMT, atau gula darah) berada di atas nilai ideal meski tidak sekritis cluster "
                      "risiko tinggi. Memerlukan edukasi gizi, modifikasi gaya hidup, dan senam lansia "
                      "rutin agar tidak berkembang menjadi penyakit kronis."),
    "RELATIF SEHAT": ("Relatif Sehat", "success",
                      "Cluster dengan profil kesehatan terbaik dibanding cluster lain. Meskipun "
                      "beberapa indikator masih di atas ambang ideal (misalnya pra-hipertensi), "
                      "cluster ini memiliki beban risiko paling ringan. Memerlukan edukasi preventif "
                      "dan pemantauan rutin untuk mempertahankan kondisi."),
}
REC_AGE_70 = "Skrining kesehatan geriatri berkala (sebulan sekali) dan pendampingan mobilitas."
REC_AGE_60 = "Skrining kesehatan lansia teratur (3 bulan sekali)."
REC_BMI_30 = "Konseling gizi klinis untuk mengatasi obesitas dan pembatasan asupan kalori."
REC_BMI_25 = "Program olahraga rutin dan edukasi porsi makan sehat untuk mengatasi overweight."
REC_BMI_UNDER = "Program PMT (Pemberian Makanan Tambahan) lansia untuk mengatasi malnutrisi."
REC_SYS_140 = "Terapi kepatuhan minum obat hipertensi, pembatasan garam, dan senam lansia."
REC_SYS_120 = "Pantau tekanan darah rutin; anjurkan diet DASH (rendah garam, tinggi kalium)."
REC_GLU_200 = "Rujukan ke poli penyakit dalam untuk penanganan DM tipe 2 dan monitoring gula rutin."
REC_GLU_140 = "Edukasi diet rendah karbohidrat sederhana dan cek gula darah puasa berkala."
REC_GLU_100 = "Waspada pra-diabetes; anjurkan aktivitas fisik aerobik minimal 30 menit/hari."
REC_CHOL_200 = "Terapi statin sesuai resep dokter dan anjuran mengurangi konsumsi lemak jenuh/gorengan."
REC_URIC_7 = "Hindari makanan tinggi purin (jeroan, kangkung) dan pastikan hidrasi cukup (≥8 gelas/hari)."
REC_GENERAL = {
    "RISIKO TINGGI": "Prioritaskan kunjungan Prolanis/Posyandu lansia dan koordinasi dengan dokter layanan primer.",
    "RISIKO SEDANG": "Ikuti program senam lansia dan konseling kesehatan minimal sebulan sekali di Posyandu.",
    "RELATIF SEHAT": "Pertahankan pola hidup sehat (PHBS); lakukan tes kesehatan rutin 3 bulan sekali.",
}


# ---------------------------------------------------------------------------
# FIXED VALUES: console evaluation bands (S20), best to worst.
# ---------------------------------------------------------------------------
CONSOLE_SILHOUETTE = ((0.5, "BAIK – cluster terpisah dengan jelas"),
                      (0.25, "CUKUP – cluster agak tumpang tindih"),
                      (None, "KURANG – cluster saling tumpang tindih"))
CONSOLE_DBI = ((1.0, "BAIK – cluster kompak & terpisah"), (2.0, "CUKUP"), (None, "KURANG"))
