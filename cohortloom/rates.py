"""US dollar value of one unit of each currency."""

# The exchange rates used for the report, by currency code.
USD_RATES = {
    "AED": 0.272234775270193,
    "AFN": 0.013149243918474688,
    "ALL": 0.009081035528643401,
    "AMD": 0.0020537229273109416,
    "ANG": 0.5437146585471945,
    "AOA": 0.003156027697299072,
    "ARS": 0.02437538086532602,
    "AUD": 0.7092701610043266,
    "AWG": 0.5552470849528041,
    "AZN": 0.5865102639296187,
    "BAM": 0.5812263876780006,
    "BBD": 0.5011777677542224,
    "BDT": 0.011871972646975022,
    "BGN": 0.5780346820809249,
    "BHD": 2.6518164942985947,
    "BIF": 0.0005525014503163071,
    "BMD": 1.0,
    "BND": 0.7404116688879017,
    "BOB": 0.14484147100997957,
    "BRL": 0.263664407941572,
    "BSD": 0.9995002498750625,
    "BTN": 0.014491598495772076,
    "BWP": 0.09384384384384384,
    "BYR": 5.102040816326531e-05,
    "BZD": 0.49512303807496166,
    "CAD": 0.7476635514018692,
    "CDF": 0.0006134969325153375,
    "CHF": 1.0036130068245686,
    "CLP": 0.0014983437308399297,
    "CNY": 0.14896247635220689,
    "COP": 0.0003237293622531564,
    "CRC": 0.0016714162745802656,
    "CUP": 0.03773584905660377,
    "CVE": 0.01028843631200712,
    "CZK": 0.043991043423558966,
    "DJF": 0.005626828719333784,
    "DKK": 0.15150826477584353,
    "DOP": 0.01971803214039239,
    "DZD": 0.008415737428992215,
    "EGP": 0.05796429399489915,
    "ERN": 0.0666680000266672,
    "ETB": 0.0350594257266066,
    "EUR": 1.075268817204301,
    "FJD": 0.47107593744111553,
    "FKP": 1.3157894736842106,
    "GBP": 1.25,
    "GEL": 0.37243947858473,
    "GHS": 0.191131498470948,
    "GIP": 1.3157894736842106,
    "GMD": 0.02013490385583409,
    "GNF": 0.00010937445261504419,
    "GTQ": 0.12978248455588434,
    "GYD": 0.0047971984361133094,
    "HKD": 0.1274356131564527,
    "HNL": 0.04082299150881777,
    "HRK": 0.1523972080831479,
    "HTG": 0.012072556061932213,
    "HUF": 0.0035799052757064047,
    "IDR": 7.048433309486134e-05,
    "ILS": 0.2768166089965398,
    "INR": 0.014496955639315743,
    "IQD": 0.0008361204013377926,
    "IRR": 2.3750148382020786e-05,
    "ISK": 0.008419634587858887,
    "JMD": 0.00799998720002048,
    "JOD": 1.4104372355430184,
    "JPY": 0.009048185205493334,
    "KES": 0.009930595071048444,
    "KGS": 0.014335622732283679,
    "KHR": 0.0002497533560732099,
    "KMF": 0.0023110668207994164,
    "KPW": 0.001111005812449109,
    "KRW": 0.0008821474786504873,
    "KWD": 3.2948929159802307,
    "KYD": 1.1971746677840296,
    "KZT": 0.002642145443237072,
    "LAK": 0.00011620749405860134,
    "LBP": 0.0006605675583249778,
    "LKR": 0.005613240961840065,
    "LRD": 0.006168080185042405,
    "LSL": 0.06954006202973533,
    "LYD": 0.7204610951008646,
    "MAD": 0.1039619914959091,
    "MDL": 0.05778008898133703,
    "MGA": 0.00028064572765150713,
    "MKD": 0.01847762821164275,
    "MMK": 0.0006520818135751566,
    "MNT": 0.0003800945112604139,
    "MOP": 0.12343088487601368,
    "MUR": 0.02896326010455737,
    "MVR": 0.06454944487477407,
    "MWK": 0.0013812440865487545,
    "MXN": 0.05270786664909738,
    "MYR": 0.2462690242821258,
    "MZN": 0.01581525254586028,
    "NAD": 0.0695405456151209,
    "NGN": 0.0027636524430687598,
    "NIO": 0.03034394865803887,
    "NOK": 0.11728554338392251,
    "NPR": 0.009094629621208676,
    "NZD": 0.6869075422448139,
    "OMR": 2.5974025974025974,
    "PAB": 0.9995002498750625,
    "PEN": 0.30414550320873507,
    "PGK": 0.2962524070508073,
    "PHP": 0.019041997124658434,
    "PKR": 0.007134184013435096,
    "PLN": 0.2635323881305012,
    "PYG": 0.00016226521724018602,
    "QAR": 0.274649821477616,
    "RON": 0.2377555872563005,
    "RSD": 0.009584061322657968,
    "RUB": 0.009991666949763897,
    "RWF": 0.0011065190570244596,
    "SAR": 0.26666666666666666,
    "SBD": 0.12413570515287313,
    "SCR": 0.0731288164101064,
    "SDG": 0.02095210558185045,
    "SEK": 0.10798319781442008,
    "SGD": 0.7401924500370096,
    "SHP": 0.7570595805889924,
    "SLL": 0.0001126760525292602,
    "SOS": 0.0017182136488706696,
    "SRD": 0.13408420488066505,
    "SVC": 0.11401468509143979,
    "SYP": 0.0019417468187390998,
    "SZL": 0.07008199593524424,
    "THB": 0.031555695803092455,
    "TJS": 0.10569372073605107,
    "TMT": 0.2857142857142857,
    "TND": 0.3311587243765937,
    "TOP": 0.4430267588162325,
    "TRY": 0.18021914648212226,
    "TTD": 0.1472515498225619,
    "TWD": 0.03243909559801472,
    "TZS": 0.0004266024146549874,
    "UAH": 0.03677133012932477,
    "UGX": 0.0002696506204323713,
    "USD": 1.0,
    "UYU": 0.030084235860409144,
    "UZS": 0.00011910288562233081,
    "VEF": 0.10012515644555695,
    "VND": 4.310066159515549e-05,
    "VUV": 0.008782808179956227,
    "WST": 0.3848077885096394,
    "XAF": 0.0017329205516579283,
    "XCD": 0.36991824806717716,
    "XDR": 1.3914011409489355,
    "XOF": 0.0017329214525624882,
    "XPF": 0.009531997963965234,
    "YER": 0.00399440144693198,
    "ZAR": 0.06973646589538135,
    "ZMW": 0.08313242996092776,
    "ZWL": 0.0031021699678925405,
}
